"""A command shell over document stores: find, add, del, commit, create, open, drop, params, pretty, dumpkeys.

Commands end with a semicolon at the end of a line. Lines that begin with # are comments.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import VariantVal

from .errors import VeldraError
from .functions.collation import render
from .plans.nodes import Record, Sequence
from .plans.parser import parse
from .sources.store import Batch, DocStore


def plain(value: Any) -> Any:
    """A collected value as plain JSON data."""
    from decimal import Decimal

    if isinstance(value, VariantVal):
        value = value.toPython()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def results(df: DataFrame, query: str, params: Any = None) -> list[Any]:
    """The rows of a query's result as JSON values, shaped by its return clause."""
    template = parse(query, params).template
    out = []
    for row in df.collect():
        values = [plain(v) for v in row]
        if isinstance(template, Record):
            out.append(dict(zip(row.__fields__, values)) if template.fields else {})
        elif isinstance(template, Sequence):
            out.append(values if template.items else [])
        else:
            out.append(values[0])
    return out


class Shell:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        """Stores are folders below ``folder``, or in memory where it is None."""
        self.spark, self.folder = spark, folder
        self.stores: dict[str, DocStore] = {}
        self.store: DocStore | None = None
        self.batch = Batch()
        self.params: str | None = None
        self.pretty = ("", "", "")

    def _open(self, name: str, create: bool) -> DocStore:
        if self.folder is not None:
            return DocStore(self.spark, f"{self.folder}/{name}", create)
        if name not in self.stores:
            if not create:
                raise VeldraError(f"no store named {name}")
            self.stores[name] = DocStore(self.spark)
        return self.stores[name]

    def _flush(self) -> None:
        batch, self.batch = self.batch, Batch()
        self.store.commit(batch)

    def run(self, command: str) -> str:
        """The output of one command, without its semicolon."""
        try:
            return self._run(command.strip())
        except VeldraError as e:
            return f"{e}\n"

    def _run(self, command: str) -> str:
        word = next((w for w in ("params", "pretty", "create", "drop", "open", "dumpkeys", "add", "del", "commit", "find") if command.startswith(w)), None)
        rest = command[len(word) :].strip() if word else ""
        if word == "pretty":
            self.pretty = ("  ", "\n", " ") if rest.startswith("on") else ("", "", "")
        elif word in ("create", "open"):
            if self.store is not None:
                self._flush()
            self.store = self._open(rest, word == "create")
        elif word == "drop":
            if self.folder is not None:
                try:
                    DocStore(self.spark, f"{self.folder}/{rest}").drop()
                except VeldraError:
                    pass
            self.stores.pop(rest, None)
        elif self.store is None:
            return "Index isn't open\n"
        elif word == "params":
            self.params = rest
        elif word == "add":
            return render(self.store.add(rest, self.batch)) + "\n"
        elif word == "del":
            return "ok\n" if self.store.delete(rest, self.batch) else "not found\n"
        elif word == "commit":
            self._flush()
        elif word == "dumpkeys":
            self._flush()
            return "".join(f"{r.seq}{r.path}={r.value}\n" for r in self.store.all_keys().collect())
        elif word == "find":
            self._flush()
            params, self.params = self.params, None
            rows = results(self.store.query(command, params), command, params)
            indent, newline, space = self.pretty
            text = [render(r, indent, newline, space, 1) if newline else render(r) for r in rows]
            return "[" + "".join(("\n" if k == 0 else ",\n") + (indent if newline else "") + t for k, t in enumerate(text)) + ("\n" if rows else "") + "]\n"
        else:
            return "Unrecognized command!\n"
        return ""


def commands(lines: TextIO) -> Iterator[str]:
    held = ""
    for line in lines:
        if not held and (line.startswith("#") or not line.strip()):
            continue
        held += line
        if line.rstrip().endswith(";"):
            yield held.strip()[:-1]
            held = ""
    if held.strip():
        yield held.strip()


def main() -> None:
    spark = SparkSession.builder.appName("veldra").getOrCreate()
    shell = Shell(spark, sys.argv[1] if len(sys.argv) > 1 else None)
    for command in commands(sys.stdin):
        sys.stdout.write(shell.run(command))
        sys.stdout.flush()
    if shell.store is not None:
        shell._flush()


if __name__ == "__main__":
    main()
