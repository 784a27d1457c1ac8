"""Searches over a table of files."""

from __future__ import annotations

import os
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernpath.functions import literals, paths, regexes
from fernpath.operators import index as idx
from fernpath.operators.build import Index


@F.pandas_udf(T.BooleanType())
def _exists(path: pd.Series) -> pd.Series:
    return path.map(os.path.exists)


def matches(df: DataFrame, patterns: list[str], *, ignore_case: bool = False, basename: bool = False, regex: bool = False, path: str = "full_path") -> Column:
    """Whether a path matches any of the patterns. A stored column `folded` saves folding paths anew."""
    if regex and not patterns:
        raise regexes.RegexError("Invalid regex: no pattern")
    tests = []
    for p in patterns:
        column = F.col(path)
        if not regex and ignore_case:
            column = F.col("folded") if path == "full_path" and "folded" in df.columns else paths.folded(column)
        column = paths.basename(column) if basename else column
        if regex:
            tests.append(column.rlike(regexes.checked(df.sparkSession, p, ignore_case)))
        else:
            tests.append(F.lit(True) if p == "" else column.contains(paths.fold(p) if ignore_case else p))
    return reduce(or_, tests, F.lit(False)) if tests else F.lit(True)


def search(
    files: DataFrame, patterns: list[str] | None = None, *, ignore_case: bool = False, basename: bool = False, regex: bool = False, limit: int | None = None,
    size: str | None = None, modified: str | None = None, mime: str | None = None, now: int | None = None, existing: bool | DataFrame = False, index: DataFrame | Index | None = None,
) -> DataFrame:
    """Files that match any pattern and all filters, with the columns they have; with a limit the first in order of their paths.

    index: a written index, or postings (kind, gram, doc_id), of files with `folded` and `nfc_ok`; it changes the plan but never the answer.
    existing: True asks the file system of the task that holds the row, last of all; a DataFrame of full_path is joined instead.
    """
    patterns = patterns or []
    if modified is not None and now is None:
        raise literals.LiteralError("a filter on time needs `now`")
    condition = matches(files, patterns, ignore_case=ignore_case, basename=basename, regex=regex) if patterns or regex else F.lit(True)
    if size is not None:
        condition = condition & literals.size(size).of(F.col("size"))
    if modified is not None:
        condition = condition & literals.modified(modified, F.col("mtime"), now)
    if mime is not None:
        condition = condition & literals.mime(mime).of(F.col("mime_type"))
    found = files
    if isinstance(index, Index) and patterns:
        found = idx.narrowed(files, index.postings, patterns, regex, index.grams, index.total)
    elif index is not None and patterns:
        found = idx.narrowed(files, index, patterns, regex)
    found = found.where(condition)
    if isinstance(existing, DataFrame):
        found = found.join(existing.select("full_path"), "full_path", "left_semi")
    elif existing:
        found = found.where(_exists("full_path"))
    return found if limit is None else found.orderBy("full_path").limit(limit)


def counted(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("count"))


def fetched(files: DataFrame, ids: list[int]) -> DataFrame:
    """The files with these doc_ids, each once, in order. An id that no file has is an error."""
    found = files.where(F.col("doc_id").isin(ids)).orderBy("doc_id")
    missing = sorted(set(ids) - {r.doc_id for r in found.select("doc_id").collect()})
    if missing:
        raise LookupError(f"no file has the number {missing[0]}")
    return found


def sliced(files: DataFrame, first: int, count: int) -> DataFrame:
    """The files numbered from `first` on, `count` of them."""
    return files.where((F.col("doc_id") >= first) & (F.col("doc_id") < first + count))
