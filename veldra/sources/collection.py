"""Collections of documents that queries run on: a typed table, or a table of JSON documents."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .text_index import TextIndex
from .values import Dynamic, Missing, Typed, Value


@dataclass
class Row(Value):
    """A row of a typed table as a document: its columns, and ``_id``."""

    df: DataFrame
    id: Column

    def get(self, key: str) -> Value:
        if key == "_id" and "_id" not in self.df.columns:
            from pyspark.sql import types as T

            return Typed(self.id, T.StringType())
        return Typed(F.col(f"`{key}`"), self.df.schema[key].dataType) if key in self.df.columns else Missing()

    def index(self, at: int) -> Value:
        return Missing()

    def elements(self):
        return None

    string = number = boolean = lambda self: None

    def is_null(self) -> Column:
        return F.lit(False)

    @property
    def column(self) -> Column:
        return F.struct(*(F.col(f"`{c}`") for c in self.df.columns))

    @property
    def type(self):
        return self.df.schema


@dataclass
class Collection:
    """``df`` with a document a row. ``seq`` orders them; it is unique and keeps its value when a document changes."""

    df: DataFrame
    id: Column
    seq: Column
    variant: bool
    #: Where the words of the texts stand, if that is kept.
    index: TextIndex | None = None

    @staticmethod
    def typed(df: DataFrame, id_column: str, seq_column: str | None = None) -> Collection:
        """Rows as documents. Predicates on plain columns stay plain, so that they reach the scan."""
        return Collection(df, F.col(f"`{id_column}`").cast("string"), F.col(f"`{seq_column or id_column}`"), False)

    @staticmethod
    def json(df: DataFrame) -> Collection:
        """A table (seq BIGINT, _id STRING, doc VARIANT), as ``DocStore`` keeps it."""
        return Collection(df, F.col("_id"), F.col("seq"), True)

    @staticmethod
    def from_json_text(df: DataFrame, text_column: str, seq_column: str) -> Collection:
        """JSON text in a column; documents without an ``_id`` get their seq as one."""
        doc = F.parse_json(F.col(text_column))
        out = df.select(F.col(seq_column).cast("bigint").alias("seq"), F.coalesce(F.try_variant_get(doc, "$._id", "string"), F.col(seq_column).cast("string")).alias("_id"), doc.alias("doc"))
        return Collection.json(out)

    @staticmethod
    def read_json_lines(spark: SparkSession, path: str) -> Collection:
        """A file or folder of JSON lines, numbered by file name and line, however the files are split."""
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
        # A row for each stretch of a file that is read at once: the number of its first row here, and of its first line in all.
        blocks = sorted(lines.groupBy("file", "start").agg(F.min("n").alias("first"), F.count("*").alias("lines")).collect(), key=lambda r: (r.file, r.start))
        begins = accumulate((r.lines for r in blocks), initial=0)
        shifts = spark.createDataFrame([(r.file, r.start, begin - r.first) for r, begin in zip(blocks, begins)], "of string, from bigint, shift bigint")
        numbered = lines.join(F.broadcast(shifts), (F.col("file") == F.col("of")) & (F.col("start") == F.col("from"))).where("trim(value) != ''")
        return Collection.from_json_text(numbered.select("value", (F.col("n") + F.col("shift")).alias("line")), "value", "line")

    def root(self) -> Value:
        return Dynamic(F.col("doc")) if self.variant else Row(self.df, self.id)

    def json_text(self) -> Column:
        """The document as JSON text, for the evaluator."""
        if self.variant:
            return F.to_json(F.col("doc"))
        return F.to_json(F.to_variant_object(F.struct(*(F.col(f"`{c}`") for c in self.df.columns), *([] if "_id" in self.df.columns else [self.id.alias("_id")]))))
