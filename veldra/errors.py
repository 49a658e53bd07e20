"""Errors of the query language and the document store."""


class VeldraError(Exception):
    prefix = ""

    def __str__(self) -> str:
        return f"{self.prefix}{super().__str__()}"


class ParseError(VeldraError):
    prefix = "Parse error: "


class ShredError(VeldraError):
    prefix = "Shred error: "


class WriteError(VeldraError):
    prefix = "Write error: "
