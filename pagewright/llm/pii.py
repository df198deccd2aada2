"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton finds anchors: at-signs, schemes and the
cues that announce an identifier. From each, a deterministic local parser walks
to the boundaries of an e-mail address, a network address or an account and
validates it. Runs of digits are the anchors of addresses, cards and phones.

Spans are (kind, start, end) in code points, end exclusive. ``base`` kinds are
email, ip, card and phone; the method adds ``handle`` (an address spelled out
as name [at] host [dot] tld), ``login`` (user and password in a URL), ``iban``
(checked modulo 97) and ``ssn`` (after its cue). Of added spans only a ``login``
may overlap others.

Defined results: a null or empty text has no span. Each row stands for itself,
so null ids, repeated rows and ties need no rule, and an empty table gives an
empty result. A text of any length takes time in proportion to it, whatever it
holds. Extra columns are ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm._session import documents

# The kinds in the order in which equal starts are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("handle", "login", "iban", "ssn")
_ORDER = {kind: i for i, kind in enumerate(BASE + ADDED)}
_CUES = ("iban", "ssn", "social security", "[at]", "(at)", "://", "@")

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Tried at the start of a run of digits only: where that fails, so does every later digit of the run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_SPELLED = re.compile(r"\s*([A-Za-z0-9-]+)((?:\s*[\[(]dot[\])]\s*[A-Za-z0-9-]+)+)", re.IGNORECASE)
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
#: Between a cue and its number: up to four link words, each after a few separators, and a few more separators.
_APART = r"""[\s:;#.,=()\[\]"'*_–—-]{0,8}"""
_LINKS = rf"(?:{_APART}(?i:numbers?|numero|número|nummer|num|nos?|nr|n[°º]|codes?|card|id|account|acct|is|was|are|of|for|the)(?![A-Za-z0-9])){{0,4}}{_APART}"
_IBAN = re.compile(rf"{_LINKS}([A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})")
_SSN = re.compile(rf"{_LINKS}([0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for cue in _CUES:
        found.add_word(cue, cue)
    found.make_automaton()
    return found


def _email(text: str, at: int, floor: int) -> Span | None:
    """Left over the local part, not before ``floor``; right over the domain."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return ("email", start, domain.end()) if domain else None


def _digits(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _added(text: str, cue: str, start: int, end: int) -> Span | None:
    if cue in ("[at]", "(at)"):
        left = start
        while left and text[left - 1] == " ":
            left -= 1
        name = left
        while name and text[name - 1] in _LOCAL:
            name -= 1
        host = _SPELLED.match(text, end) if name < left else None
        return ("handle", name, host.end()) if host else None
    if cue == "://":
        m = _LOGIN.match(text, end)
        scheme = start
        while scheme and text[scheme - 1].isascii() and text[scheme - 1].isalnum():
            scheme -= 1
        return ("login", scheme, m.end()) if m and scheme < start else None
    if start and text[start - 1].isalnum():
        return None
    if cue == "iban":
        m = _IBAN.match(text, end)
        if m:
            raw = m[1]
            while len(raw.replace(" ", "")) >= 15:  # the run may go on into the next word
                if _mod97(raw.replace(" ", "")):
                    return "iban", m.start(1), m.start(1) + len(raw)
                raw = raw[:-1].rstrip()
        return None
    m = _SSN.match(text, end)
    if m and m[1][:3] not in ("000", "666") and m[1][0] != "9" and m[1][4:6] != "00" and m[1][7:] != "0000":
        return "ssn", m.start(1), m.end(1)
    return None


def _lowered(text: str) -> str:
    """Lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class _Covered:
    """What spans cover, as separate stretches in order."""

    def __init__(self, found: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in found:
            self.add(a, b)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        first, last = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if first < last:
            start, end = min(start, self.starts[first]), max(end, self.ends[last - 1])
        self.starts[first:last], self.ends[first:last] = [start], [end]


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind."""
    if not text:
        return [], []
    base: list[Span] = []
    floor, cues = 0, []
    for last, cue in _automaton().iter(_lowered(text)):
        if cue == "@":
            if found := _email(text, last, floor):
                base.append(found)
                floor = found[2]
        else:
            cues.append((cue, last + 1 - len(cue), last + 1))
    base.extend(_digits(text))
    base.sort(key=lambda s: (s[1], _ORDER[s[0]]))
    more: list[Span] = []
    covered = _Covered(base) if cues else None
    for cue, start, end in cues:
        found = _added(text, cue, start, end)
        if found and (cue == "://" or not covered.meets(*found[1:])):
            more.append(found)
            covered.add(*found[1:])
    return base, sorted(base + more, key=lambda s: (s[1], _ORDER[s[0]])) if more else base


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def masked(text: str, found: list[Span]) -> str:
    """The text with each span, or each run of spans that overlap, replaced by its first kind's name."""
    out, at, end = [], 0, 0
    for kind, a, b in found:
        if a >= end:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [spans(x.as_py()) for x in batch.column(1)]
        counts = [pa.array([sum(kind == k for kind, _, _ in base) for base, _ in rows], pa.int64()) for k in BASE]
        digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([joined(full) for _, full in rows], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans of each text of ``docs`` (doc_id long, text)."""
    return docs.select("doc_id", "text").mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_chars``, where there is one, set anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x and masked(x, spans(x)[1]) for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([old if new is None else len(new) for new, old in zip(texts, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
