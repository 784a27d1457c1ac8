"""Results as text: JSON lines and arrays, plain paths, NUL-terminated paths, a table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernpath.functions import paths


def as_json(found: DataFrame) -> DataFrame:
    """One JSON object a row, in a column `json`."""
    return found.select(F.to_json(F.struct(F.col("full_path").alias("path"), "size", "mtime", "mode", "mime_type")).alias("json"))


def json_array(found: DataFrame) -> Iterator[str]:
    """The pieces of a JSON array, streamed in path order."""
    yield "["
    for k, r in enumerate(as_json(found.orderBy("full_path")).toLocalIterator()):
        yield (",\n " if k else "\n ") + r.json
        last = k
    yield "\n]" if "last" in locals() else "]"


def terminated(found: DataFrame, end: str = "\0") -> Iterator[str]:
    """Paths in order, each with an end: NUL, or a line feed for plain output."""
    for r in found.orderBy("full_path").select("full_path").toLocalIterator():
        yield r.full_path + end


# Terminal codes of the colours that sizes and times have.
_CODES = {"grey": "90", "red": "31", "bright red": "91", "yellow": "33", "green": "32", "bright green": "92", "white": "37", "magenta": "35", "name": "1;97"}


def _painted(text, colour) -> Column:
    codes = F.create_map(*(F.lit(x) for pair in _CODES.items() for x in pair))
    return F.concat(F.lit("\x1b["), codes[colour], F.lit("m"), text, F.lit("\x1b[0m"))


def cells(found: DataFrame, now: int, width: int = 80, icons: bool = False, colour: bool = False) -> DataFrame:
    """(full_path, size_text, time_text, path_text) of a table: what each cell shows, with icons and colours if wanted."""
    size, age = paths.human_size(F.col("size")), paths.relative_time(F.col("mtime"), now)
    shown = paths.display_path(F.col("full_path"), max(width - 30, 10))
    if colour:
        name = paths.basename(F.col("full_path"))
        before = F.substring(shown, F.lit(1), F.length(shown) - F.length(name))
        shown = F.when(F.length(name) > 0, F.concat(before, _painted(name, F.lit("name")))).otherwise(shown)
        size, age = _painted(size, paths.size_colour(F.col("size"))), _painted(age, paths.time_colour(F.col("mtime"), now))
    shown = F.concat(paths.icon(F.col("full_path")), shown) if icons else shown
    return found.select("full_path", size.alias("size_text"), age.alias("time_text"), shown.alias("path_text"))


def table(found: DataFrame, now: int, width: int = 80, icons: bool = False, colour: bool = False) -> Iterator[str]:
    """The lines of a table in path order, sizes and times right-aligned before the paths; in 50 columns or fewer, paths only.

    Column widths come from an aggregate, so the rows are streamed and never held as a whole.
    """
    shown = cells(found, now, width, icons, colour)
    if width <= 50:
        yield from (r.full_path for r in shown.select("full_path").orderBy("full_path").toLocalIterator())
        return
    seen = {k: paths.visible_width(F.col(f"{k}_text")) for k in ("size", "time")}
    widest = shown.agg(*(F.coalesce(F.max(w), F.lit(0)).alias(k) for k, w in seen.items())).first()
    s, t = max(len("Size"), widest["size"]), max(len("Modified"), widest["time"])
    yield f"{'Size':>{s}}  {'Modified':>{t}}  Path"
    for r in shown.select("*", *(w.alias(f"{k}_width") for k, w in seen.items())).orderBy("full_path").toLocalIterator():
        yield f"{' ' * (s - r.size_width)}{r.size_text}  {' ' * (t - r.time_width)}{r.time_text}  {r.path_text}"
