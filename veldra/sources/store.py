"""A store of JSON documents: a table (seq, _id, doc as JSON text) in Parquet folders, read as VARIANT.

A version is a file of its own that names a base table, the changes made since (newest last; a null text takes the
document out) and the text index of the base. It appears as a whole, under a number that no other writer may have taken,
so that a reader sees one version or the next, and of two writers that began with the same version the second is told.
A batch of changes writes only what it changes; every ``COMPACT`` batches they are merged into a new base.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from ..deploy import ship
from ..errors import ShredError, WriteError
from ..functions.collation import dumps
from .collection import Collection
from .text_index import TextIndex

#: Layout of the files; a store of another one isn't opened.
FORMAT = 2
#: Batches of changes after which they are merged into a new base.
COMPACT = 10
#: Documents that a store in memory may hold.
MEMORY = 1_000_000
SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("_id", T.StringType()), T.StructField("text", T.StringType())])


def with_id(document: str | dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """The document with its ``_id``, a new random one where it has none. A key that comes twice counts as it came last."""
    try:
        doc = json.loads(document) if isinstance(document, str) else dict(document)
    except ValueError as e:
        raise ShredError(str(e)) from e
    if not isinstance(doc, dict):
        raise ShredError("Expected a JSON object")
    doc.setdefault("_id", uuid.uuid4().hex)
    if not isinstance(doc["_id"], str):
        raise ShredError("Expected string for `_id` field, got another type")
    return doc["_id"], doc


def merge_changes(base: DataFrame, added: DataFrame, removed: DataFrame, next_seq: int) -> DataFrame:
    """``base`` (seq, _id, text) after ``removed`` (_id) is taken out and ``added`` (_id, text) put in.

    An added document keeps the seq of the one that it replaces; new ones are numbered from ``next_seq`` in row order,
    with gaps. If an ``_id`` is added more than once the last row counts.
    """
    numbered = added.withColumn("__n", F.monotonically_increasing_id())
    last = numbered.withColumn("__k", F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("__n")))).where("__k = 1").select(F.col("_id").alias("__id"), F.col("text").alias("__text"), "__n")
    kept = base.join(removed.select(F.col("_id").alias("__gone")), F.col("_id") == F.col("__gone"), "left_anti")
    both = kept.join(last, F.col("_id") == F.col("__id"), "full_outer")
    return both.select(F.coalesce("seq", F.lit(next_seq) + F.col("__n")).alias("seq"), F.coalesce("_id", "__id").alias("_id"), F.when(F.col("__id").isNotNull(), F.col("__text")).otherwise(F.col("text")).alias("text"))


class Batch:
    """Changes that are written together. One change for each ``_id``."""

    def __init__(self):
        self.added: dict[str, str] = {}
        self.removed: set[str] = set()


@dataclass
class Version:
    number: int = 0
    base: str = ""
    deltas: list[str] = field(default_factory=list)
    index: str | None = None
    following: int = 0
    format: int = FORMAT


class DocStore:
    def __init__(self, spark: SparkSession, path: str | None = None, create: bool = False):
        """``path`` None: a store in memory, for interactive use and tests."""
        ship(spark)
        self.spark, self.path = spark, path.rstrip("/") if path else None
        self._table: DataFrame | None = None
        if self.path is None:
            self._hold(spark.createDataFrame([], SCHEMA), 0)
        elif (newest := self._newest()) is None:
            if not create:
                raise WriteError(f"no store at {path}")
            self._rewrite(spark.createDataFrame([], SCHEMA), Version())
        elif self._read(newest).format != FORMAT:
            raise WriteError(f"the store at {path} has format {self._read(newest).format}, not {FORMAT}")

    # Files

    def _fs(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _newest(self) -> int | None:
        fs, path = self._fs("versions")
        if not fs.exists(path):
            fs, old = self._fs("current")
            if fs.exists(old):
                raise WriteError(f"the store at {self.path} has format 1, not {FORMAT}")
            return None
        return max((int(n) for f in fs.listStatus(path) if (n := f.getPath().getName()).isdigit()), default=None)

    def _read(self, number: int) -> Version:
        fs, path = self._fs(f"versions/{number:020d}")
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        known = json.loads(text)
        return Version(**known) if known.get("format") == FORMAT else Version(format=known.get("format", 0))

    def version(self) -> Version:
        """The current version."""
        newest = self._newest()
        if newest is None:
            raise WriteError(f"no store at {self.path}")
        return self._read(newest)

    def _publish(self, version: Version) -> None:
        """Makes a version the current one, unless another writer has taken its number."""
        fs, fresh = self._fs(f"versions/new-{uuid.uuid4().hex}")
        target = self._fs(f"versions/{version.number:020d}")[1]
        out = fs.create(fresh, False)
        out.write(bytearray(json.dumps(asdict(version)).encode()))
        out.close()
        if fs.getUri().getScheme() == "file":
            # Renaming would replace a file; a link is refused where one is.
            try:
                os.link(fresh.toUri().getPath(), target.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
            fs.delete(fresh, False)
        else:
            done = not fs.exists(target) and fs.rename(fresh, target)
        if not done:
            raise WriteError("another writer has committed since; read again and repeat the changes")

    def _rewrite(self, table: DataFrame, before: Version) -> Version:
        """A new version of one base table."""
        name = f"base-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/{name}")
        top = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}").agg(F.max("seq")).first()[0]
        version = Version(before.number + 1, name, [], None, max(before.following, -1 if top is None else top + 1))
        if before.index:
            version.index = self._indexed(version)
        self._publish(version)
        return version

    def _indexed(self, version: Version) -> str:
        name = f"index-{uuid.uuid4().hex}"
        TextIndex.build(self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{version.base}"), f"{self.path}/{name}")
        return name

    def _hold(self, table: DataFrame, following: int) -> None:
        rows = table.limit(MEMORY + 1).collect()
        if len(rows) > MEMORY:
            raise WriteError(f"a store in memory holds at most {MEMORY} documents; give it a path")
        self._table, self._next = self.spark.createDataFrame(rows, SCHEMA), following

    def drop(self) -> None:
        if self.path is not None:
            fs, path = self._fs()
            fs.delete(path, True)
        else:
            self._hold(self.spark.createDataFrame([], SCHEMA), 0)

    # Reading

    def _changes(self, version: Version) -> DataFrame | None:
        """The last change of each changed _id, (seq, _id, text); a null text takes the document out."""
        if not version.deltas:
            return None
        parts = [self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}").withColumn("k", F.lit(k)) for k, name in enumerate(version.deltas)]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.union(part)
        return whole.groupBy("_id").agg(F.max_by(F.struct("seq", "text"), "k").alias("last")).select("last.seq", "_id", "last.text")

    def _at(self, version: Version) -> DataFrame:
        base, changes = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{version.base}"), self._changes(version)
        if changes is None:
            return base
        kept = base.join(changes.select(F.col("_id").alias("changed")), F.col("_id") == F.col("changed"), "left_anti")
        return kept.union(changes.where("text is not null"))

    def table(self) -> DataFrame:
        return self._table if self.path is None else self._at(self.version())

    def collection(self) -> Collection:
        """The committed documents as they are now."""
        self.spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        version = None if self.path is None else self.version()
        table = self._table if version is None else self._at(version)
        found = Collection.json(table.select("seq", "_id", F.parse_json("text").alias("doc")))
        if version and version.index:
            changes = self._changes(version)
            if changes is None:
                found.index = TextIndex(self.spark, f"{self.path}/{version.index}")
            else:
                base = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{version.base}")
                changed = base.join(changes.select(F.col("_id").alias("changed")), F.col("_id") == F.col("changed"), "left_semi")
                found.index = TextIndex(self.spark, f"{self.path}/{version.index}", changed.select("seq"), changes.where("text is not null"))
        return found

    def query(self, text: str, params: Any = None, ordered: bool = True) -> DataFrame:
        from ..plans.engine import run

        return run(self.collection(), text, params, ordered)

    # Changes

    def add(self, document: str | dict[str, Any], batch: Batch) -> str:
        key, doc = with_id(document)
        if key in batch.added or key in batch.removed:
            raise WriteError("Attempt to insert multiple docs with same _id")
        batch.added[key] = dumps(doc)
        return key

    def delete(self, key: str, batch: Batch) -> bool:
        return key in self.delete_all([key], batch)

    def delete_all(self, keys: list[str], batch: Batch) -> set[str]:
        """Takes documents out; gives the keys that there were. One job for all."""
        if len(set(keys)) < len(keys) or any(k in batch.added or k in batch.removed for k in keys):
            raise WriteError("Attempt to delete doc with same _id added earlier")
        wanted = self.spark.createDataFrame([(k,) for k in keys], "wanted string")
        found = {r._id for r in self.table().join(F.broadcast(wanted), F.col("_id") == F.col("wanted"), "left_semi").select("_id").collect()}
        batch.removed |= found
        return found

    def commit(self, batch: Batch) -> None:
        if batch.added or batch.removed:
            added = self.spark.createDataFrame(list(batch.added.items()), "_id string, text string").coalesce(1)
            self.apply(added, self.spark.createDataFrame([(k,) for k in batch.removed], "_id string"))

    def apply(self, added: DataFrame, removed: DataFrame) -> None:
        """Bulk change: documents (_id, text) to put in, ids (_id) to take out. WriteError if another writer commits meanwhile."""
        if self.path is None:
            rows = merge_changes(self._table, added, removed, self._next).limit(MEMORY + 1).collect()
            # In memory, numbers follow without gaps.
            new = sorted(r.seq for r in rows if r.seq >= self._next)
            place = {s: self._next + i for i, s in enumerate(new)}
            self._hold(self.spark.createDataFrame([(place.get(r.seq, r.seq), r._id, r.text) for r in rows], SCHEMA), self._next + len(new))
            return
        version = self.version()
        name = f"delta-{uuid.uuid4().hex}"
        numbered = added.withColumn("n", F.monotonically_increasing_id()).groupBy("_id").agg(F.max("n").alias("n"), F.max_by("text", "n").alias("text"))
        here = self._at(version).select("seq", F.col("_id").alias("here"))
        put = numbered.join(here, F.col("_id") == F.col("here"), "left").select(F.coalesce("seq", F.lit(version.following) + F.col("n")).alias("seq"), "_id", "text")
        out = removed.distinct().join(here, F.col("_id") == F.col("here")).join(numbered.select(F.col("_id").alias("again")), F.col("_id") == F.col("again"), "left_anti").select("seq", "_id", F.lit(None).cast("string").alias("text"))
        put.union(out).write.parquet(f"{self.path}/{name}")
        top = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}").agg(F.max("seq")).first()[0]
        version.number, version.deltas = version.number + 1, [*version.deltas, name]
        version.following = max(version.following, -1 if top is None else top + 1)
        if len(version.deltas) > COMPACT:
            version.number -= 1
            self._rewrite(self._at(version), version)
        else:
            self._publish(version)

    def compact(self) -> None:
        """Merges the changes into a new base, with a new text index if there was one."""
        if self.path is not None and (version := self.version()).deltas:
            self._rewrite(self._at(version), version)

    def index_text(self) -> None:
        """Makes a text index of the documents, which word searches and scores use from now on."""
        if self.path is None:
            raise WriteError("a store in memory has no text index; give it a path")
        self.compact()
        version = self.version()
        version.index, version.number = self._indexed(version), version.number + 1
        self._publish(version)

    def vacuum(self) -> None:
        """Removes what only former versions need; readers that began with those must be done."""
        fs, root = self._fs()
        version = self.version()
        used = {version.base, version.index, *version.deltas, "versions"}
        for status in fs.listStatus(root):
            if status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)
        for status in fs.listStatus(self._fs("versions")[1]):
            if status.getPath().getName() != f"{version.number:020d}":
                fs.delete(status.getPath(), False)

    def all_keys(self) -> DataFrame:
        """A listing of the stored leaves: (seq, path, value), for debugging."""

        def walk(value: Any, path: str):
            if isinstance(value, dict) and value:
                for k, v in value.items():
                    yield from walk(v, f"{path}.{k}")
            elif isinstance(value, list) and value:
                for i, v in enumerate(value):
                    yield from walk(v, f"{path}[{i}]")
            else:
                yield path, dumps(value)

        import pandas as pd

        kind = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))
        listed = F.pandas_udf(lambda texts: pd.Series([[{"path": p, "value": v} for p, v in walk(json.loads(t), "")] for t in texts], dtype=object), kind)
        return self.table().select("seq", F.explode(listed("text")).alias("leaf")).select("seq", "leaf.path", "leaf.value")
