"""Table functions for SQL: one row in, many out. ``register`` makes them known to a session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from pagewright.operators import pixels

REGION = "region_id int, center_x double, center_y double, thickness double, length double, angle double, vertical boolean, score double"


class MapRegions:
    """``map_regions(values, width, gain)``: the regions of a probability map given row by row; values times ``gain`` are held to 0 and 1."""

    def eval(self, values: list[float] | None, width: int, gain: float) -> Iterator[tuple]:
        if values and width > 0 and len(values) % width == 0:
            found = pixels.regions(np.clip(gain * np.array(values, float).reshape(-1, width), 0, 1))
            for i, r in enumerate(found):
                yield (i, *map(float, r[:5]), bool(r.vertical), float(r.score))


class TextLines:
    """``text_lines(text)``: its lines, numbered from 1; a null text has none."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        for i, line in enumerate([] if text is None else text.split("\n")):
            yield i + 1, line


class WrappedWords:
    """``wrapped_words(TABLE(words), columns)``: of rows (key, n, word) the lines of each key, of at most so many letters where a word allows.

    Rows come key by key, in the order of ``n``: what the function asks for by ``analyze``.
    """

    def __init__(self) -> None:
        self.key, self.line, self.number = None, "", 0

    @staticmethod
    def analyze(words: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        fields = {f.name: f.dataType for f in words.dataType.fields}
        if missing := {"key", "n", "word"} - set(fields):
            raise ValueError(f"the table has no {', '.join(sorted(missing))}")
        if not isinstance(columns.value, int) or columns.value < 1:
            raise ValueError("columns is a number from 1")
        schema = StructType([StructField("key", fields["key"]), StructField("line", IntegerType()), StructField("text", StringType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("n")])

    def eval(self, words: Row, columns: int) -> Iterator[tuple]:
        word = words["word"]
        self.key = words["key"]
        if not word:
            return
        if self.line and len(self.line) + 1 + len(word) > columns:
            self.number += 1
            yield self.key, self.number, self.line
            self.line = word
        else:
            self.line += (" " if self.line else "") + word

    def terminate(self) -> Iterator[tuple]:
        if self.line:
            yield self.key, self.number + 1, self.line


def register(spark: SparkSession) -> None:
    spark.udtf.register("map_regions", udtf(MapRegions, returnType=REGION))
    spark.udtf.register("text_lines", udtf(TextLines, returnType="line int, text string"))
    spark.udtf.register("wrapped_words", udtf(WrappedWords))
