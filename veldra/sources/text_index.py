"""A persisted text index: where each word stem stands in which field of which document, and how often in all.

Two Parquet tables. ``postings`` (path, stem, seq, at, places, n): a row for each distinct stem of a text; ``at`` tells
array elements of one path apart, ``places`` are the word's places in the text and ``n`` its number of words.
``terms`` (path, stem, rows, hits): how many texts have the stem, and how often. Both are sorted by (path, stem), so a
query reads the row groups of its words only; a frequent word's rows may span many files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import stems

POSTINGS = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("at", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("n", T.IntegerType())]
)


def path_name(path: tuple[str, ...]) -> str:
    """A key path as one string: keys as JSON texts, $ for the elements of an array."""
    return "".join("$" if step == "$" else json.dumps(step[1:]) for step in path)


def texts(value: Any, path: tuple[str, ...] = (), at: str = "") -> Iterator[tuple[tuple[str, ...], str, str]]:
    """(path, element numbers, text) of the texts in a document."""
    if isinstance(value, str):
        yield path, at, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from texts(v, (*path, "." + k), at)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from texts(v, (*path, "$"), f"{at}{i}.")


def postings(documents: DataFrame) -> DataFrame:
    """The postings of a table (seq, text) of JSON documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for seq, text in zip(batch["seq"], batch["text"]):
                for path, at, value in texts(json.loads(text)):
                    found = stems(value)
                    places: dict[str, list[int]] = {}
                    for i, s in enumerate(found):
                        places.setdefault(s, []).append(i)
                    name = path_name(path)
                    rows += [(name, s, seq, at, p, len(found)) for s, p in places.items()]
            yield pd.DataFrame(rows, columns=POSTINGS.names)

    return documents.select("seq", "text").mapInPandas(run, POSTINGS)


class TextIndex:
    """An index in a folder, with the changes made since: documents whose postings don't count any more, and new ones."""

    def __init__(self, spark: SparkSession, folder: str, changed: DataFrame | None = None, fresh: DataFrame | None = None):
        self.spark, self.folder, self.changed, self.fresh = spark, folder, changed, fresh

    @staticmethod
    def build(documents: DataFrame, folder: str) -> None:
        spark = documents.sparkSession
        postings(documents).repartitionByRange("path", "stem", "seq").sortWithinPartitions("path", "stem", "seq").write.parquet(f"{folder}/postings")
        rows = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
        terms = rows.groupBy("path", "stem").agg(F.count("*").alias("rows"), F.sum(F.size("places")).alias("hits"))
        terms.repartitionByRange("path", "stem").sortWithinPartitions("path", "stem").write.parquet(f"{folder}/terms")

    def find(self, wanted: dict[tuple[str, ...], list[str]]) -> DataFrame:
        """The postings of some stems by path."""
        test: Column = F.lit(False)
        for path, found in wanted.items():
            test = test | (F.col("path") == path_name(path)) & F.col("stem").isin(list(found))
        rows = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings").where(test)
        if self.changed is not None:
            rows = rows.join(self.changed.select(F.col("seq").alias("changed")), F.col("seq") == F.col("changed"), "left_anti")
        return rows if self.fresh is None else rows.union(postings(self.fresh).where(test))

    def counts(self, path: tuple[str, ...], wanted: list[str]) -> tuple[int, list[int]]:
        """(distinct stems of all texts of a path summed up, how often each stem stands there)."""
        if self.changed is None and self.fresh is None:
            terms = self.spark.read.parquet(f"{self.folder}/terms").where(F.col("path") == path_name(path))
            got = terms.agg(F.sum("rows").alias("fields"), *(F.sum(F.when(F.col("stem") == s, F.col("hits"))).alias(f"s{k}") for k, s in enumerate(wanted))).first()
        else:
            rows = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings").where(F.col("path") == path_name(path)).select("path", "stem", "seq", "at", "places", "n")
            if self.changed is not None:
                rows = rows.join(self.changed.select(F.col("seq").alias("changed")), F.col("seq") == F.col("changed"), "left_anti")
            if self.fresh is not None:
                rows = rows.union(postings(self.fresh).where(F.col("path") == path_name(path)))
            got = rows.agg(F.count("*").alias("fields"), *(F.sum(F.when(F.col("stem") == s, F.size("places"))).alias(f"s{k}") for k, s in enumerate(wanted))).first()
        return got.fields or 0, [got[f"s{k}"] or 0 for k in range(len(wanted))]
