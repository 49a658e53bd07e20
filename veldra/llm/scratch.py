"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from ..deploy import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on a local master without that setting, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="veldra-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Writes tables that cut lineage and survive the loss of executors.

    ``drop`` frees those no longer read, ``sweep`` all that were written since some point; what is left goes when the
    application ends.
    """

    #: Folders written by this application, oldest first.
    roots: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/veldra-{uuid.uuid4().hex}"
        fs, path = self._at("")
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        Scratch.roots.append(self)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._at(name)
            fs.delete(path, True)

    @classmethod
    def sweep(cls, since: int) -> None:
        """Drops the folders made after the first ``since``; nothing may read them any more."""
        gone, cls.roots[since:] = cls.roots[since:], []
        for scratch in gone:
            scratch.drop("")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch; by default Spark sends 64 MB at once, which many executors can't spare beside their heap.
BATCH_BYTES = 4 << 20
_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40, "p": 50, "pb": 50}


def size_in_bytes(text: str) -> int:
    """A size as Spark's settings write it (``16m``, ``64kb``, ``4096``)."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", text.lower())
    if not found or found[2] not in _UNITS:
        raise ValueError(f"{text!r} is no size")
    return int(found[1]) << _UNITS[found[2]]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name like each of ``names`` that ``df`` has no column of, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of a few MB, so that what a Python worker holds follows the batch, not the partition.

    ``function`` sees the columns by place; their names are c0, c1, ... there, as names with dots or ones that occur
    twice can't be passed on. The session's setting for the size of Arrow batches is lowered to BATCH_BYTES where it
    is larger, for Spark reads it when the plan runs.
    """
    ship(df.sparkSession)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < size_in_bytes(df.sparkSession.conf.get(key, "64m")) <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        # Workers live on between stages; what they don't need any more goes back to the machine.
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)


def add_column(df: DataFrame, read: str, name: str, kind: T.DataType, values: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """``df`` with a last column ``name``, computed from the column ``read``."""
    at = df.columns.index(read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values(batch.column(at)))], [*batch.schema.names, "added"])

    fields = [T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(df.schema.fields)]
    return map_arrow(df, run, T.StructType([*fields, T.StructField("added", kind)])).toDF(*df.columns, name)


def filter_rows(df: DataFrame, columns: list[str], accept: Callable[..., np.ndarray]) -> DataFrame:
    """The rows of ``df`` for which ``accept``, given the named columns as Arrow arrays, is true; no shuffle, no join."""
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(accept(*(batch.column(k) for k in at)), pa.bool_()))

    return map_arrow(df, run, T.StructType([T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(df.schema.fields)])).toDF(*df.columns)
