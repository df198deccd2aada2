"""Jobs in flight: what each reply, failure and deadline means for a pool of workers.

A pool's messages come as rows (pool, at, event, device, generation, crop, ms,
columns), ``at`` in seconds. Events are ``ready`` (with the price that the
warm-up measured), ``sent``, ``done``, ``failed``, ``died`` and ``page`` (a new
generation begins). State is what is in flight by generation and crop, the
workers' prices, and the generation; it outlives pages and batches, and holds
no more than is in flight.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.operators.telemetry import READY_SECONDS, REPLY_SECONDS

MESSAGE = "pool long, at double, event string, device int, generation long, crop long, ms double, columns int"
OUTCOME = "pool long, at double, device int, generation long, crop long, outcome string, price double"
_COLUMNS = [c.split()[0] for c in OUTCOME.split(", ")]


@dataclass
class Pool:
    generation: int = 0
    prices: dict[str, float] = field(default_factory=dict)
    flying: dict[str, list] = field(default_factory=dict)  # "generation/crop": [device, deadline]
    starting: dict[str, float] = field(default_factory=dict)  # device: deadline


def _retired(pool: Pool, device: int) -> list[tuple[int, int]]:
    """Takes a device and all its jobs away; the jobs, in order."""
    pool.prices.pop(str(device), None)
    pool.starting.pop(str(device), None)
    own = sorted(tuple(map(int, key.split("/"))) for key, (d, _) in pool.flying.items() if d == device)
    for generation, crop in own:
        del pool.flying[f"{generation}/{crop}"]
    return own


def _late(pool: Pool, now: float) -> Iterator[tuple]:
    """Devices whose deadline has passed go, with their jobs."""
    for device in sorted(int(d) for d, end in pool.starting.items() if end <= now):
        _retired(pool, device)
        yield now, device, None, None, "worker-start-timeout", None
    for device in sorted({d for d, end in pool.flying.values() if end <= now}):
        for generation, crop in _retired(pool, device):
            yield now, device, generation, crop, "worker-response-timeout", None


def step(pool: Pool, m: dict[str, Any]) -> Iterator[tuple]:
    """(at, device, generation, crop, outcome, price) of what a message, and the time it came at, bring about."""
    at, event, device = m["at"], m["event"], m["device"]
    yield from _late(pool, at)
    key = f"{m['generation']}/{m['crop']}"
    if event == "page":
        pool.generation = max(pool.generation, m["generation"])
    elif event == "start":
        pool.starting[str(device)] = at + READY_SECONDS
    elif event == "ready":
        pool.starting.pop(str(device), None)
        pool.prices[str(device)] = m["ms"] / m["columns"]
    elif event == "sent":
        if str(device) not in pool.prices:
            yield at, device, m["generation"], m["crop"], "worker-unavailable", None
        else:
            pool.flying[key] = [device, at + REPLY_SECONDS]
    elif event == "done":
        flown = pool.flying.pop(key, None)
        price = pool.prices.get(str(device))
        if m["generation"] != pool.generation:
            yield at, device, m["generation"], m["crop"], "stale", price
        elif flown is None or flown[0] != device:
            yield at, device, m["generation"], m["crop"], "worker-protocol", price
        else:
            pool.prices[str(device)] = price = (price + m["ms"] / m["columns"]) / 2
            yield at, device, m["generation"], m["crop"], "answer", price
    elif event in ("failed", "died"):
        yield at, device, None, None, f"worker-{event}", None
        for generation, crop in _retired(pool, device):
            yield at, device, generation, crop, "purged", None
    else:
        yield at, device, m["generation"], m["crop"], "worker-protocol", None


def _fold(pool: Pool, key: int, messages: pd.DataFrame) -> pd.DataFrame:
    out = []
    whole = ("device", "generation", "crop", "columns")
    for m in messages.sort_values("at", kind="stable").to_dict("records"):
        m = {k: None if pd.isna(v) else int(v) if k in whole else v for k, v in m.items()}
        out += [(key, *row) for row in step(pool, m)]
    return pd.DataFrame(out, columns=_COLUMNS).astype({"pool": "int64", "at": "float64", "device": "Int32", "generation": "Int64", "crop": "Int64", "price": "float64"})


def outcomes(messages: DataFrame) -> DataFrame:
    """What becomes of each pool's messages; one pool's come together, pools are independent."""
    return messages.groupBy("pool").applyInPandas(lambda key, rows: _fold(Pool(), key[0], rows), OUTCOME)


def _keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pool = Pool(**json.loads(state.get[0])) if state.exists else Pool()
    found = _fold(pool, key[0], pd.concat(list(batches)))
    state.update((json.dumps(asdict(pool)),))
    yield found


def live_outcomes(messages: DataFrame, keep: Callable = _keep) -> DataFrame:
    """The same of a stream of messages, whatever batches they come in; a deadline shows with the message after it."""
    return messages.groupBy("pool").applyInPandasWithState(keep, OUTCOME, "pool string", "append", GroupStateTimeout.NoTimeout)


def in_order(answers: DataFrame, crops: DataFrame) -> DataFrame:
    """Answers (pool, generation, crop, ...) joined back to their crops' rows, by the crop's place."""
    return crops.join(answers, ["pool", "generation", "crop"])
