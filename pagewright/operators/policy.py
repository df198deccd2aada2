"""Known false readings: refused only outside the scripts a page is expected to have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import text as tx

# Scripts of languages.
LANGUAGE_SCRIPTS = {
    "ar": ("Arab",),
    "az": ("Latn",),
    "el": ("Grek",),
    "en": ("Latn",),
    "he": ("Hebr",),
    "ja": ("Hani", "Hira", "Kana"),
    "ka": ("Geor",),
    "pt": ("Latn",),
    "ru": ("Cyrl",),
    "zh": ("Hani",),
}
BELOW_CONFIDENCE = 0.6


def scripts_of_languages(languages: Column) -> Column:
    table = F.create_map(*(x for k, v in LANGUAGE_SCRIPTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(languages, lambda x: F.coalesce(F.try_element_at(table, tx.language_base(x)), none))))


def expected_scripts(page_scripts: Column, page_languages: Column, model_scripts: Column, model_languages: Column) -> Column:
    """The page's own scripts; where it says nothing, the model's."""
    page = F.array_union(page_scripts, scripts_of_languages(page_languages))
    return F.when(F.size(page) > 0, page).otherwise(F.array_union(model_scripts, scripts_of_languages(model_languages)))


def accepted(text: Column, confidence: Column, readings: list[str], expected: Column, below: float = BELOW_CONFIDENCE) -> Column:
    """False for a listed reading of low confidence all of whose scripts are unexpected."""
    if not 0.0 <= below <= 1.0:
        raise ValueError("below must be between 0 and 1")
    if not all(readings):
        raise ValueError("a reading cannot be empty")
    found = tx.scripts(text)
    listed = text.isin(*readings) if readings else F.lit(False)
    outside = (F.size(found) > 0) & (F.size(F.coalesce(expected, F.array().cast("array<string>"))) > 0) & ~F.arrays_overlap(found, expected)
    return ~(listed & (confidence < below) & outside)
