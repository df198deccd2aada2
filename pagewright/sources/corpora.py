"""Corpora made by rule: cases as rows, each with its page, written as images and a manifest.

Glyphs come from ``backends.glyph``, a rule that has one for every letter, so no
font is needed; the fonts named in a manifest are sizes and styles of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.pixels import quarter_turned
from pagewright.sources import corpus, sinks

#: Fixed value: the seed of all that is made here.
SEED = 20260301
#: Scripts: name, script, language, direction, first letter, letters.
SCRIPTS = [
    ("russian", "Cyrl", "ru", "ltr", 0x430, 32), ("greek", "Grek", "el", "ltr", 0x3B1, 17), ("japanese", "Jpan", "ja", "ltr", 0x3042, 80), ("mandarin", "Hans", "zh", "ltr", 0x4E00, 900),
    ("arabic", "Arab", "ar", "rtl", 0x641, 10), ("azerbaijani", "Latn", "az", "ltr", 0x61, 26), ("hebrew", "Hebr", "he", "rtl", 0x5D0, 27), ("georgian", "Geor", "ka", "ltr", 0x10D0, 33),
]


def rule(*key: object) -> np.random.Generator:
    """Numbers that the seed and a key fix."""
    return np.random.default_rng([SEED, *"/".join(map(str, key)).encode()])


def made_lines(n: int, words: int, first: int, letters: int, *key: object) -> list[str]:
    """Lines of words of letters from a range of code points."""
    r = rule("lines", *key)
    return [" ".join("".join(chr(first + int(x)) for x in r.integers(0, letters, r.integers(2, 8))) for _ in range(words)) for _ in range(n)]


def made_numbers(n: int, *key: object) -> list[str]:
    """Lines of amounts, as a bill has them."""
    r = rule("numbers", *key)
    return [", ".join(f"{r.integers(1, 900)}.{r.integers(0, 100):02}" for _ in range(3)) for _ in range(n)]


#: Texts of the benchmark: words, longer words, amounts, labels with amounts, a single line.
TEXTS = [
    ("en", made_lines(2, 5, 0x61, 26, "plain")), ("pt", made_lines(3, 4, 0x61, 26, "longer")), ("en", made_numbers(3, "amounts")),
    ("en", [f"{a}: {b}" for a, b in zip(made_lines(3, 1, 0x61, 26, "labels"), made_numbers(3, "labels"), strict=True)]), ("fr", made_lines(1, 6, 0x61, 26, "single")),
]
CONFUSED = ["花", "回"]
BLACK_ON_WHITE = {"foreground": "#000000", "background": "#FFFFFF"}
_ROLES = {"primary": "ruled", "alternate": "ruled-wide"}
#: Languages whose alternate style is the primary one.
_ROLE_OVERRIDES = {("ar", "alternate"): "ruled", ("he", "alternate"): "ruled"}
_NOBODY = {"pagewright": None, "paddleocr": None, "tesseract": None}


class Look(NamedTuple):
    """How a page is set and degraded."""

    name: str
    unit: int = 3
    pad: int = 12
    role: str = "primary"
    palette: dict[str, str] = BLACK_ON_WHITE
    objects: tuple[str, ...] = ()
    degrade: Callable[[np.ndarray], np.ndarray] = lambda page: page


LOOKS = [
    Look("clean-unit3"), Look("clean-unit2", unit=2), Look("clean-unit4", unit=4), Look("clean-wide", role="alternate"), Look("clean-loose", pad=40),
    Look("skew-5deg", degrade=lambda p: corpus.skewed(p, 5.0)), Look("skew-12deg", degrade=lambda p: corpus.skewed(p, 12.0)), Look("blur-5px", degrade=lambda p: corpus.blurred(p, 5)),
    Look("noise-sigma25", degrade=corpus.noisy), Look("lossy-q25", degrade=lambda p: corpus.lossy(p, 25)), Look("faded-40pc", degrade=lambda p: corpus.faded(p, 0.4)),
]


def palette(dark: bool, *key: object) -> dict[str, str]:
    """Two colours far apart in brightness, of hues that the key fixes."""
    r = rule("palette", *key)
    shade = lambda low, high: "#" + "".join(f"{int(x):02X}" for x in r.integers(low, high, 3))
    ink, ground = shade(0, 80), shade(190, 256)
    return {"foreground": ground, "background": ink} if dark else {"foreground": ink, "background": ground}


SCRIPT_LOOKS = [
    Look("clean"),
    Look("tinted-loose", unit=3, pad=56, role="alternate", palette=palette(False, "tinted"), objects=("polygon", "circle")),
    Look("inverse-large", unit=5, pad=64, palette=palette(True, "inverse"), objects=("circle", "rectangle")),
]


def font(role: str, language: str) -> dict[str, str]:
    """The font of a role: a language's own, if it has one, else the role's."""
    family = _ROLE_OVERRIDES.get((language, role), _ROLES[role])
    return {"family": family, "file": family, "source": "by rule", "version": "1", "license": "CC0-1.0"}


def colour(text: str) -> np.ndarray:
    return np.array([int(text[i : i + 2], 16) for i in (1, 3, 5)], float)


def objects_of(width: int, height: int, kinds: Sequence[str]) -> list[dict]:
    """What stands beside the text: each object in a margin, of a place, size and colour that the page's size and its turn fix."""
    records = []
    for turn, kind in enumerate(kinds):
        r = rule("object", width, height, turn, kind)
        margin = max(10, min(width, height) // 6)
        w, h = (int(x) for x in r.integers(margin // 2, margin, 2))
        h = w if kind == "circle" else h
        along = int(r.integers(0, max(1, width - w)))
        top = 2 if turn % 2 else max(0, height - h - 2)
        records.append({"kind": kind, "bounds": [along, top, w, h], "fill": "#" + "".join(f"{int(x):02X}" for x in r.integers(90, 220, 3))})
    return records


def decorated(page: np.ndarray, palette: dict[str, str], kinds: Sequence[str]) -> tuple[np.ndarray, list[dict]]:
    """The page's ink in the palette's colours over its objects, and a record of each."""
    height, width = page.shape[:2]
    y, x = np.mgrid[0:height, 0:width]
    ground = np.tile(colour(palette["background"]), (height, width, 1))
    records = objects_of(width, height, kinds)
    for record in records:
        left, top, w, h = record["bounds"]
        u, v = (x - left + 0.5) / w, (y - top + 0.5) / h
        box = (u > 0) & (u < 1) & (v > 0) & (v < 1)
        inside = {"rectangle": box, "circle": (u - 0.5) ** 2 + (v - 0.5) ** 2 < 0.25, "polygon": box & (np.abs(u - 0.5) < v / 2)}[record["kind"]]
        ground[inside] = colour(record["fill"])
    ink = (255 - page.mean(axis=2, keepdims=True)) / 255
    return np.rint(ground * (1 - ink) + colour(palette["foreground"]) * ink).astype(np.uint8), records


def icons(n: int = 4, cell: int = 120) -> tuple[np.ndarray, list[dict]]:
    """A page of signs that are no letters, in a row: rings and frames in each other, of widths that a rule fixes."""
    y, x = np.mgrid[0:cell, 0:cell] - (cell - 1) / 2
    page, records = np.full((cell, n * cell, 3), 255, np.uint8), []
    for i in range(n):
        r = rule("icon", i)
        kind = "circle" if i % 2 == 0 else "rectangle"
        away = np.hypot(x, y) if kind == "circle" else np.maximum(np.abs(x), np.abs(y))
        edges = np.cumsum(r.integers(5, 12, 4))
        page[:, i * cell : (i + 1) * cell][np.searchsorted(edges, away) % 2 == 0] = 24
        side = 2 * int(edges[-1])
        records.append({"kind": kind, "bounds": [i * cell + cell // 2 - side // 2, cell // 2 - side // 2, side, side], "fill": "#181818"})
    return page, records


def case(id_: str, look: Look, page: np.ndarray, lines: Sequence[str], *, script: str, language: str, direction: str = "ltr", objects: Sequence[dict] = (), recognition: dict | None = None, **more) -> tuple[dict, np.ndarray]:
    """A case's entry in the manifest, with its page; ``more`` replaces what holds unless said otherwise."""
    height, width = page.shape[:2]
    usual = {"content_label": "text", "known_false_readings": [], "font": font(look.role, language)}
    own = {
        "id": id_, "script": script, "language": language, "direction": direction, "lines": list(lines), "palette": look.palette, "size": {"font_px": 7 * look.unit, "width_px": width, "height_px": height},
        "background_objects": list(objects), "recognition": recognition or _NOBODY | {"pagewright": {"model": "v6-medium"}}, "variant": look.name, "image": f"{id_}.png",
    }
    return usual | own | more, page


def benchmark_cases() -> list[Callable[[], tuple[dict, np.ndarray]]]:
    """Five texts in eleven looks."""
    made = lambda i, language, lines, look: case(f"case{i:02}-{look.name}", look, look.degrade(corpus.render(lines, look.unit * (1 + (look.role == "alternate")), look.pad)), lines, script="Latn", language=language)
    return [lambda i=i, language=language, lines=lines, look=look: made(i, language, lines, look) for i, (language, lines) in enumerate(TEXTS) for look in LOOKS]


def script_cases() -> list[Callable[[], tuple[dict, np.ndarray]]]:
    """Eight scripts in three looks, a page of letters that are easily taken for signs, and two without letters."""

    def made(name, script, language, direction, first, letters, look):
        lines = made_lines(2, 3, first, letters, name)
        page = corpus.render(lines, look.unit, look.pad, letters=None, right_to_left=direction == "rtl")
        page, objects = decorated(page, look.palette, look.objects)
        return case(f"{name}-{look.name}".removesuffix("-clean"), look, page, lines, script=script, language=language, direction=direction, objects=objects)

    def signs():
        page, objects = icons()
        return case("negative-glyph-icons", Look("negative-glyph-icons"), page, [], script="Zyyy", language="und", objects=objects, content_label="negative-glyph-icon", known_false_readings=CONFUSED, font=None, recognition=_NOBODY)

    def shapes():
        look = Look("negative-background-objects", objects=("circle", "rectangle", "polygon"))
        page, objects = decorated(np.full((240, 320, 3), 255, np.uint8), look.palette, look.objects)
        return case("negative-background-objects", look, page, [], script="Zyyy", language="und", objects=objects, content_label="negative-background-object", known_false_readings=CONFUSED, font=None, recognition=_NOBODY)

    confused = lambda: case("positive-cjk-confused", look := Look("positive-cjk-confused", unit=6, pad=52), corpus.render(CONFUSED, look.unit, look.pad, letters=None), CONFUSED, script="Hans", language="zh", content_label="positive-cjk")
    return [*(lambda d=d, look=look: made(*d, look) for d in SCRIPTS for look in SCRIPT_LOOKS), confused, signs, shapes]


def orientation_cases() -> list[Callable[[], tuple[dict, np.ndarray]]]:
    """One page turned by each multiple of a quarter."""
    language, lines = TEXTS[0]
    base = corpus.render(lines, 4, 48)
    return [lambda t=t: case(f"orientation-{t:03}deg", Look(f"orientation-{t}deg", unit=4, pad=48), quarter_turned(base, t), lines, script="Latn", language=language) for t in (0, 90, 180, 270)]


CORPORA = {"benchmark": benchmark_cases, "script": script_cases, "orientation": orientation_cases}


def cases(spark: SparkSession, name: str) -> DataFrame:
    """(place, case: JSON, image, content: PNG) of a corpus, each page made in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = CORPORA[name]()
        for batch in batches:
            for place in batch.column(0).to_pylist():
                entry, page = makers[place]()
                yield pa.record_batch({"place": pa.array([place], pa.int64()), "case": pa.array([json.dumps(entry, ensure_ascii=False)]), "image": pa.array([entry["image"]]), "content": pa.array([corpus.png(np.ascontiguousarray(page))], pa.binary())})

    return spark.range(len(CORPORA[name]())).mapInArrow(run, "place long, case string, image string, content binary")


def write(spark: SparkSession, name: str, folder: str) -> int:
    """Writes a corpus: its images by tasks, then the manifest; returns how many cases there are."""
    return sinks.write_corpus(cases(spark, name), folder)


def uncovered(texts: DataFrame, coverage: DataFrame, text: Column) -> DataFrame:
    """(columns of ``texts`` but the text, letter): letters, not spaces or format characters, that ``coverage`` (letter) lacks."""
    letters = F.array_distinct(F.split(F.regexp_replace(text, r"[\s\p{Z}\p{Cf}]", ""), ""))
    rows = texts.withColumn("letter", F.explode(F.filter(letters, lambda x: x != "")))
    return rows.join(coverage.select("letter").distinct(), "letter", "left_anti")
