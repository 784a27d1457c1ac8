"""Filter literals such as `10MB+`, `2d-` and `image/*`, read on the driver and turned into column conditions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class LiteralError(ValueError):
    """A filter literal that cannot be read."""


@dataclass(frozen=True)
class Bound:
    """A number and how a column compares with it: `ge`, `le` or `eq`."""

    value: int
    op: str

    def of(self, column: Column) -> Column:
        return {"ge": column >= self.value, "le": column <= self.value, "eq": column == self.value}[self.op]


_SIZE_UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9}
_TIME_UNITS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}


def _suffix(text: str, plus: str, minus: str) -> tuple[str, str]:
    ops = {"+": plus, "-": minus}
    return (text[:-1], ops[text[-1]]) if text and text[-1] in ops else (text, "eq")


def size(text: str) -> Bound:
    """Bytes in decimal units; `+` means at least, `-` at most, neither exactly."""
    body, op = _suffix(text.strip(), "ge", "le")
    found = re.fullmatch(r"\s*([0-9]+)\s*([A-Za-z]*)\s*", body, re.ASCII)
    if not found or found[2].lower() not in _SIZE_UNITS:
        raise LiteralError(f"Invalid size: {text!r}")
    value = int(found[1]) * _SIZE_UNITS[found[2].lower()]
    if value >= 1 << 64:
        raise LiteralError(f"Size out of range: {text!r}")
    return Bound(value, op)


def age(text: str) -> Bound:
    """Seconds before now. `+` means older, so a smaller time; `-` newer, so a larger one; neither the exact second."""
    body, op = _suffix(text.strip(), "le", "ge")
    found = re.fullmatch(r"([+-]?[0-9]+)([mhdw])", body, re.ASCII)
    if not found:
        raise LiteralError(f"Invalid duration: {text!r}")
    return Bound(int(found[1]) * _TIME_UNITS[found[2]], op)


def modified(text: str, column: Column, now: int) -> Column:
    bound = age(text)
    return Bound(now - bound.value, bound.op).of(column)


@dataclass(frozen=True)
class Mime:
    """A type, or what is left of a glob without its star: a prefix."""

    text: str
    prefix: bool

    def of(self, column: Column) -> Column:
        return column.startswith(self.text) if self.prefix else column == F.lit(self.text)


def mime(text: str) -> Mime:
    text = text.strip()
    if "/" not in text or text.count("*") > 1:
        raise LiteralError(f"Invalid MIME type: {text!r}")
    return Mime(text.replace("*", ""), "*" in text)
