"""Runs a query on a collection: the text is parsed, compiled to expressions, and left to Catalyst."""

from __future__ import annotations

import json
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..deploy import ship
from ..functions.collation import collation_key
from ..functions.text import counts_udf
from ..operators.aggregates import bound_value, build
from ..operators.evaluate import Evaluator, all_words, bound, field_instances, final_score, inverse_frequency, word_leaves
from ..operators.predicates import Compiler, NeedsPython, prefilters, split
from ..operators.returning import as_json, literal, or_default, walk
from ..sources.collection import Collection
from ..sources.text_index import path_name
from ..sources.values import Dynamic, Typed, Value
from .nodes import All, And, Equal, Field, Literal, Node, Not, Or, Path, Query, Range, Record, Score, Sequence, Template, leaves
from .parser import binds as bind_names
from .parser import parse


def _bare(node: Node, v: Value) -> Column | None:
    """The clause as a plain comparison in which NULL will do for false, so that it can be pushed to the scan."""
    if isinstance(node, (And, Or)):
        left, right = _bare(node.left, v), _bare(node.right, v)
        if left is None or right is None:
            return None
        return left & right if isinstance(node, And) else left | right
    if isinstance(node, Field):
        return _bare(node.body, v.get(node.key))
    if isinstance(node, Not) and isinstance(node.body, Equal) and isinstance(v, Typed) and node.body.value is not None:
        same = _bare(node.body, v)
        return None if same is None else (v.column != F.lit(node.body.value)) | v.column.isNull()
    if not isinstance(v, Typed) or isinstance(v.type, T.VariantType):
        return None
    if isinstance(node, Equal):
        if node.value is None:
            return v.column.isNull()
        column = v.boolean() if isinstance(node.value, bool) else v.string() if isinstance(node.value, str) else v.number()
        return None if column is None else column == _exact(node.value, v)
    if isinstance(node, Range) and (column := v.number()) is not None:
        value = _exact(node.value, v)
        return {">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value}[node.op]
    return None


def _exact(value: Any, v: Typed) -> Column:
    """A literal in the column's own integer type where it has the value, so that no cast keeps it from the scan."""
    if isinstance(value, float) and value.is_integer() and isinstance(v.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 53}[type(v.type)]
        if abs(value) < 1 << bits:
            return F.lit(int(value)).cast(v.type)
    return F.lit(value)


class _Run:
    def __init__(self, collection: Collection, query: Query):
        self.source, self.query = collection, query
        self.root = collection.root()
        self.binds: dict[str, list[tuple[Column, Any]]] = {}
        self.score: Column | None = None

    # Filter

    def filtered(self) -> DataFrame:
        df, find = self.source.df, self.query.find
        idf = norm = None
        if self.query.needs_score:
            idf, norm = self._weights()
        df = df.withColumn("__seq", self.source.seq)
        compiler = Compiler(idf, all_words(find), once=bool(self.query.needs_score or bind_names(find)))
        if self.source.index is not None:
            df = self._placed(df, compiler)
        try:
            whole = compiler.run(find, self.root)
        except NeedsPython:
            return self._in_python(df, idf, norm)
        if not compiler.placed:
            for test in prefilters(find, self.root):
                df = df.where(test)
        rest = []
        for part in split(find):
            plain = _bare(part, self.root)
            if plain is not None:
                df = df.where(plain)
            elif not isinstance(part, All):
                rest.append(part)
        for name, places in compiler.places.items():
            df = df.withColumn(name, places)
        for part in rest:
            again = Compiler(None, compiler.wanted, compiler.places, compiler._names, compiler.placed)
            df = df.where(again.run(part, self.root).pred)
        self.binds = whole.binds
        if norm is not None:
            f = lambda c: c.cast("float")
            total, on = F.lit(0.0).cast("float"), F.lit(0)
            for t in whole.terms:
                total, on = f(total + F.coalesce(t, F.lit(0.0).cast("float"))), on + F.when(t.isNotNull(), 1).otherwise(0)
            self.score = f(f(f(F.lit(float(norm)).cast("float") * total) * f(on)) / F.lit(float(max(1, len(whole.terms)))).cast("float"))
        return df

    def _placed(self, df: DataFrame, compiler: Compiler) -> DataFrame:
        """Adds the places of the query's words from the text index; paths through arrays are left to the tokeniser."""
        wanted = {path: stems for path, stems in all_words(self.query.find).items() if "$" not in path}
        if not wanted:
            return df
        names = {path_name(path): path for path in wanted}
        columns = []
        for k, (name, path) in enumerate(names.items()):
            own = F.col("path") == name
            columns += [F.map_from_entries(F.collect_list(F.when(own, F.struct("stem", "places")))).alias(f"__places{k}"), F.max(F.when(own, F.col("n"))).alias(f"__words{k}")]
            compiler.placed[path] = f"__places{k}", f"__words{k}"
        found = self.source.index.find(wanted).groupBy(F.col("seq").alias("__placed")).agg(*columns)
        # Where some word must be there, only documents that have one of the words are read on.
        needed = bool(prefilters(self.query.find, self.root))
        return df.join(found, F.col("__seq") == F.col("__placed"), "inner" if needed else "left")

    def _weights(self) -> tuple[dict[tuple[tuple[str, ...], str], np.float32], np.float32]:
        """Term weights from counts over the whole collection, only for the paths and stems of the query."""
        found = word_leaves(self.query.find)
        wanted: dict[tuple[str, ...], list[str]] = {}
        for path, words in found:
            if words:
                own = wanted.setdefault(path, [])
                own += [s for s in words.stems if s not in own]
        idf: dict[tuple[tuple[str, ...], str], np.float32] = {}
        for path, stems in wanted.items():
            if self.source.index is not None:
                fields, hits = self.source.index.counts(path, stems)
                idf |= {(path, s): inverse_frequency(fields, n) for s, n in zip(stems, hits)}
                continue
            if "$" in path:
                instances = F.pandas_udf(lambda docs, p=path: pd.Series([field_instances(json.loads(d), p) for d in docs], dtype=object), T.ArrayType(T.StringType()))
                rows = self.source.df.select(F.explode(instances(self.source.json_text())).alias("text"))
            else:
                v = self.root
                for step in path:
                    v = v.get(step[1:])
                text = v.string()
                rows = None if text is None else self.source.df.select(text.alias("text")).where("text is not null")
            counts = None
            if rows is not None:
                counted = rows.select(counts_udf(stems)("text").alias("found"))
                counts = counted.agg(F.sum(F.col("found")[0]).alias("fields"), *(F.sum(F.col("found")[k + 1]).alias(f"s{k}") for k in range(len(stems)))).first()
            for k, s in enumerate(stems):
                idf[path, s] = inverse_frequency(*((counts.fields or 0, counts[f"s{k}"] or 0) if counts else (0, 0)))
        total = np.float32(0)
        for path, words in found:
            for w in [idf[path, s] for s in words.stems] if words else [np.float32(1)]:
                total = np.float32(total + np.float32(w * w))
        return idf, np.float32(1) / total if total else np.float32(0)

    def _in_python(self, df: DataFrame, idf, norm) -> DataFrame:
        """One Arrow pass of the evaluator over the documents that the plain conjuncts leave."""
        find = self.query.find
        for part in split(find):
            plain = _bare(part, self.root)
            if plain is not None:
                df = df.where(plain)

        def run(docs: pd.Series) -> pd.DataFrame:
            evaluate = Evaluator(find, idf)
            found = [evaluate(json.loads(d)) for d in docs]
            return pd.DataFrame(
                {
                    "matched": [r.matched for r in found],
                    "score": pd.Series([float(final_score(r.terms, norm)) if norm is not None and r.matched else 0.0 for r in found], dtype="float32"),
                    "binds": [json.dumps({k: bound(v) for k, v in r.binds.items()}) if r.matched else "{}" for r in found],
                }
            )

        udf = F.pandas_udf(run, T.StructType([T.StructField("matched", T.BooleanType()), T.StructField("score", T.FloatType()), T.StructField("binds", T.StringType())]))
        df = df.withColumn("__found", udf(self.source.json_text())).where("__found.matched")
        self.score = F.col("__found.score")
        found = F.from_json(F.col("__found.binds"), "map<string,array<string>>")
        for name in bind_names(find):
            self.binds[name] = [(F.transform(F.try_element_at(found, F.lit(name)), F.parse_json), Dynamic)]
        return df

    # Return

    def value(self, path: Path) -> Value:
        if path.bind is None:
            return walk(self.root, path.steps)
        parts = self.binds.get(path.bind, [])
        if not parts:
            return Dynamic(F.to_variant_object(F.array(literal(path.default, True)))) if self.source.variant else Typed(F.array(F.lit(path.default).cast("string")), T.ArrayType(T.StringType()))
        arrays = [F.coalesce(c, F.filter(c, lambda e: F.lit(False)), F.array()) if len(parts) > 1 else c for c, _ in parts]
        array = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
        return bound_value(F.coalesce(array, F.array()), parts[0][1], path, self.source.variant)

    def column(self, template: Template) -> Column:
        variant = self.source.variant
        if isinstance(template, Literal):
            return literal(template.value, variant)
        if isinstance(template, Score):
            score = self.score.cast("double")
            return score.cast("variant") if variant else score
        if isinstance(template, Path):
            return or_default(self.value(template), template.default, variant)
        if isinstance(template, Record):
            column = F.struct(*(self.column(v).alias(k) for k, v in template.fields)) if template.fields else F.from_json(F.lit("{}"), T.MapType(T.StringType(), T.StringType()))
        else:
            items = [self.column(v) for v in template.items]
            column = (F.array(*items) if variant else F.struct(*(c.alias(f"_{k + 1}") for k, c in enumerate(items)))) if items else F.array().cast("array<string>")
        return F.to_variant_object(column) if variant else column

    @staticmethod
    def names(template: Template) -> list[tuple[str, Template]]:
        if isinstance(template, Record) and template.fields:
            return list(template.fields)
        if isinstance(template, Sequence) and template.items:
            return [(f"_{k + 1}", v) for k, v in enumerate(template.items)]
        if isinstance(template, Path):
            return [(template.aggregate or next((s for s in reversed(template.steps) if isinstance(s, str)), template.bind or "doc"), template)]
        return [("score" if isinstance(template, Score) else "value", template)]

    def sort_keys(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """The keys, and the table with those as columns that aren't columns yet: a sort works out an expression at every comparison."""
        returned = {x.steps: x for x in leaves(self.query.template) if isinstance(x, Path) and x.bind is None}
        keys = []
        for k, order in enumerate(self.query.order):
            if order.steps is None:
                key, plain = self.score, False
            else:
                default = returned[order.steps].default if order.steps in returned else order.default
                v = walk(self.root, order.steps)
                plain = default is None and isinstance(v, Typed) and len(order.steps) == 1
                if self.source.variant or isinstance(v, Typed) and isinstance(v.type, T.VariantType):
                    df = df.withColumn(f"__text{k}", as_json(v, default))
                    key, plain = collation_key(F.col(f"__text{k}")), False
                else:
                    key = or_default(v, default, False)
            if not plain:
                df = df.withColumn(f"__key{k}", key)
                key = F.col(f"__key{k}")
            keys.append(key.desc() if order.descending else key.asc())
        return df, keys

    def dataframe(self, ordered: bool) -> DataFrame:
        df = self.filtered()
        template, limit = self.query.template, self.query.limit
        if any(isinstance(x, Path) and x.aggregate for x in leaves(template)):
            return self._aggregated(df, ordered)
        if self.query.order:
            df, keys = self.sort_keys(df)
            df = df.orderBy(*keys, F.col("__seq").desc())
        elif ordered or limit is not None:
            # The whole collection is listed by the text of seq, all else by seq.
            df = df.orderBy(F.col("__seq").cast("string") if ordered and isinstance(self.query.find, All) else F.col("__seq"))
        if limit is not None:
            df = df.limit(limit)
        return df.select(*(self.column(v).alias(k) for k, v in self.names(template)))

    def _aggregated(self, df: DataFrame, ordered: bool) -> DataFrame:
        template, variant = self.query.template, self.source.variant
        parts, results, place = [], {}, {}
        for k, leaf in enumerate(leaves(template)):
            if isinstance(leaf, Path):
                part = build(leaf, self.value(leaf), str(k), variant)
                parts.append(part)
                place[id(leaf)] = k
                for name, column in part.rows.items():
                    df = df.withColumn(name, column)
                if part.result is not None:
                    results[f"__r{k}"] = part.result
        keys = [p.key for p in parts if p.key]
        grouped = df.groupBy(*(keys or [F.lit(1).alias("__all")]))
        out = grouped.agg(*(c.alias(n) for n, c in results.items())) if results else grouped.agg(F.count(F.lit(1)).alias("__n"))
        sorts = [p.sort for p in parts if p.sort is not None]
        if sorts and (ordered or self.query.limit is not None):
            out = out.orderBy(*sorts)
        if self.query.limit is not None:
            out = out.limit(self.query.limit)
        text = {"count", "sum", "avg"}

        def column(t: Template) -> Column:
            if isinstance(t, Literal):
                return literal(t.value, variant)
            if isinstance(t, Path):
                k = place[id(t)]
                name = f"__r{k}" if f"__r{k}" in results else parts[k_part[k]].key
                c = F.col(name)
                return (c.cast("variant") if t.aggregate in text else F.parse_json(c)) if variant else c
            if isinstance(t, Record):
                made = F.struct(*(column(v).alias(k) for k, v in t.fields))
            else:
                made = F.array(*(column(v) for v in t.items)) if variant else F.struct(*(column(v).alias(f"_{k + 1}") for k, v in enumerate(t.items)))
            return F.to_variant_object(made) if variant else made

        k_part = {k: n for n, k in enumerate(place.values())}
        null = lambda c: F.coalesce(c, F.parse_json(F.lit("null"))) if variant else c
        return out.select(*(null(column(v)).alias(k) for k, v in self.names(template)))


def run(collection: Collection, text: str | Query, params: str | dict[str, Any] | None = None, ordered: bool = False) -> DataFrame:
    """The result of a query as a DataFrame.

    A top-level object gives a column a key, an array columns _1, _2, ...; anything else one column. On JSON
    collections values are VARIANT, on typed tables they have the types of the columns. ``ordered`` asks for the
    language's default order (by seq, groups by key), which otherwise is only made where a limit or order clause
    needs it, as a global sort is dear.
    """
    ship(collection.df.sparkSession)
    return _Run(collection, text if isinstance(text, Query) else parse(text, params)).dataframe(ordered)


