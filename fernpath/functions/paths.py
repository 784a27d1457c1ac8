"""Column functions over paths, sizes and times."""

from __future__ import annotations

import mimetypes
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernpath.schema import OCTETS


def fold(text: str) -> str:
    """NFC, then full case folding."""
    return unicodedata.normalize("NFC", text).casefold()


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """fold() of a column. No built-in function folds fully, so it is computed once, when an index is built."""
    return text.map(fold, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def composed(text: pd.Series) -> pd.Series:
    """Whether a text is in NFC."""
    return text.map(lambda t: t is not None and unicodedata.is_normalized("NFC", t))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """What stands before the last slash."""
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the last component; empty for none, and for names that only start with a dot."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def grams(text: Column, n: int) -> Column:
    """Sorted distinct windows of n characters. For n = 3 shorter texts are padded with underscores on both sides."""
    windows = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))))
    short = F.array(F.substring(F.concat(F.lit("_"), text, F.lit("__")), 1, 3)) if n == 3 else F.array().cast("array<string>")
    short = F.when(F.length(text) == 0, F.array(F.lit("___"))).otherwise(short) if n == 3 else short
    return F.when(F.length(text) >= n, windows).otherwise(short)


# Types of extensions that the standard table lacks or names otherwise.
_TYPES = {
    "log": "text/plain", "md": "text/markdown", "rs": "text/x-rust", "py": "text/x-python", "gz": "application/gzip", "bz2": "application/x-bzip2", "xz": "application/x-xz",
    "zst": "application/zstd", "7z": "application/x-7z-compressed", "rar": "application/vnd.rar", "webp": "image/webp", "avif": "image/avif", "heic": "image/heic",
    "ico": "image/x-icon", "wav": "audio/wav", "flac": "audio/flac", "ogg": "audio/ogg", "m4a": "audio/mp4", "mkv": "video/x-matroska", "toml": "text/x-toml", "yaml": "text/x-yaml",
    "yml": "text/x-yaml", "ts": "text/x-typescript", "go": "text/x-go", "rb": "text/x-ruby", "java": "text/x-java", "cpp": "text/x-c", "hpp": "text/x-c", "xml": "text/xml",
    "parquet": "application/vnd.apache.parquet", "sqlite": "application/vnd.sqlite3", "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "odt": "application/vnd.oasis.opendocument.text", "epub": "application/epub+zip",
}
#: The registered types that Python's standard library knows, the same on every machine, and those above.
MIME_BY_EXTENSION = {e.lstrip("."): t for e, t in mimetypes.MimeTypes(filenames=()).types_map[True].items()} | _TYPES
# First bytes of common formats.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b", "application/gzip"), (b"\x7fELF", "application/x-executable"), (b"BZh", "application/x-bzip2"),
    (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"), (b"OggS", "audio/ogg"), (b"ID3", "audio/mpeg"), (b"#!", "text/x-shellscript"),
    (b"\xfd7zXZ\x00", "application/x-xz"), (b"\x28\xb5\x2f\xfd", "application/zstd"), (b"Rar!\x1a\x07", "application/vnd.rar"), (b"fLaC", "audio/flac"),
    (b"\x1a\x45\xdf\xa3", "video/x-matroska"), (b"SQLite format 3\x00", "application/vnd.sqlite3"), (b"PAR1", "application/vnd.apache.parquet"),
    (b"II*\x00", "image/tiff"), (b"MM\x00*", "image/tiff"), (b"BM", "image/bmp"), (b"\x00\x00\x01\x00", "image/x-icon"), (b"<?xml", "text/xml"),
    (b"<!DOCTYPE html", "text/html"), (b"<html", "text/html"), (b"{\\rtf", "text/rtf"), (b"%!PS", "application/postscript"), (b"wOFF", "font/woff"),
    (b"wOF2", "font/woff2"), (b"\x00\x01\x00\x00\x00", "font/ttf"), (b"OTTO", "font/otf"), (b"\xca\xfe\xba\xbe", "application/java-vm"), (b"\x00asm", "application/wasm"),
]


def mime_by_extension(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(extension(path))), F.lit(OCTETS))


def mime_by_content(head: Column) -> Column:
    """The type by a file's first bytes (a binary column), null for unknown ones."""
    found = F.lit(None).cast("string")
    for magic, kind in reversed(MAGIC):
        found = F.when(F.substring(head, 1, len(magic)) == F.lit(magic), kind).otherwise(found)
    return found


def mime_type(path: Column, head: Column | None = None) -> Column:
    """By extension; by content only where there is neither a known type nor any extension."""
    by_name = mime_by_extension(path)
    if head is None:
        return by_name
    return F.when((by_name == OCTETS) & (extension(path) == ""), F.coalesce(mime_by_content(head), F.lit(OCTETS))).otherwise(by_name)


def under(path: Column, root: str) -> Column:
    """Whether a path is root or lies below it, by whole components."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def human_size(size: Column) -> Column:
    """`512 B`, `1.5 KB`: units of 1024 with one decimal, ties to even."""
    made = F.concat(size.cast("string"), F.lit(" B"))
    for unit, name in ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB")):
        made = F.when(size >= unit, F.concat(F.format_string("%.1f", F.bround(size / F.lit(unit), 1)), F.lit(" " + name))).otherwise(made)
    return made


_SPANS = [(60, 1, "seconds"), (3600, 60, "minutes"), (86400, 3600, "hours"), (604800, 86400, "days"), (2592000, 604800, "weeks")]


def relative_time(mtime: Column, now: int) -> Column:
    past = F.lit(now) - mtime
    made = F.concat(F.floor(past / 2592000).cast("string"), F.lit(" months ago"))
    for below, unit, name in reversed(_SPANS):
        made = F.when(past < below, F.concat(F.floor(past / unit).cast("string"), F.lit(f" {name} ago"))).otherwise(made)
    return F.when(past < 0, F.lit("in the future")).otherwise(made)


def size_colour(size: Column) -> Column:
    made = F.lit("bright red")
    for below, name in ((1 << 30, "red"), (100 << 20, "yellow"), (1 << 20, "green"), (1 << 10, "grey")):
        made = F.when(size < below, name).otherwise(made)
    return made


def time_colour(mtime: Column, now: int) -> Column:
    past, made = F.lit(now) - mtime, F.lit("grey")
    for below, name in ((2592000, "white"), (604800, "yellow"), (86400, "green"), (3600, "bright green"), (0, "magenta")):
        made = F.when(past < below, name).otherwise(made)
    return made


# Icons by extension.
ICONS = {
    "\ue7a8 ": ["rs"], "\ue606 ": ["py"], "\ue74e ": ["js"], "\ue628 ": ["ts"], "\ue60b ": ["json"], "\uf16f ": ["yaml", "yml"], "\uf48a ": ["md"],
    "\uf724 ": ["pdf"], "\uf7e8 ": ["png", "jpg", "jpeg", "gif", "svg"], "\uf1c6 ": ["zip", "tar", "gz", "bz2"], "\ue795 ": ["sh", "bash", "zsh"],
    "\ue61e ": ["c", "h", "cpp", "hpp"], "\ue627 ": ["go"], "\ue791 ": ["rb"], "\ue749 ": ["css"], "\uf13b ": ["html"], "\ue6b2 ": ["toml"], "\uf023 ": ["lock"],
}
OTHER_ICON = "\uf713 "


def icon(path: Column) -> Column:
    """The sign before a path, by its extension as it is written."""
    made = F.lit(OTHER_ICON)
    for sign, names in ICONS.items():
        made = F.when(extension(path).isin(names), sign).otherwise(made)
    return made


def display_path(path: Column, width: int) -> Column:
    """The path itself if it fits, else `...`, the end of its directory and its name; the name alone if even that is too tight."""
    name = basename(path)
    folder = F.substring(path, F.lit(1), F.greatest(F.length(path) - F.length(name) - 1, F.lit(0)))
    room = F.lit(width) - F.length(name) - 4
    return F.when(F.length(path) <= width, path).when(room <= 0, name).otherwise(F.concat(F.lit("..."), F.substring(folder, F.greatest(F.length(folder) - room + 1, F.lit(1)), F.length(folder)), F.lit("/"), name))


def rfc3339(mtime: Column) -> Column:
    """UTC, whatever the session's zone; `unknown` for null."""
    utc = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(mtime), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(F.concat(utc, F.lit("+00:00")), F.lit("unknown"))


def visible_width(text: Column) -> Column:
    return F.octet_length(F.regexp_replace(text, "\x1b\\[[0-9;]*m", ""))
