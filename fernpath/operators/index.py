"""N-gram postings of folded paths, their statistics, and candidates for a search: a superset of its answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernpath.functions import paths
from fernpath.functions.regexes import ANYTHING, All, both, either, needed


def with_folds(files: DataFrame) -> DataFrame:
    """The files with `folded` and `nfc_ok`, computed once."""
    return files.withColumn("folded", paths.folded("full_path")).withColumn("nfc_ok", paths.composed("full_path"))


def postings(files: DataFrame, n: int = 3) -> DataFrame:
    """(gram, doc_id), each pair once, from the folded paths."""
    return files.select("doc_id", F.explode(paths.grams(F.col("folded"), n)).alias("gram")).select("gram", "doc_id")


def extension_postings(files: DataFrame) -> DataFrame:
    return files.select(paths.extension(F.col("full_path")).alias("gram"), "doc_id").where("gram <> ''")


def all_postings(files: DataFrame) -> DataFrame:
    """(kind, gram, doc_id) of trigrams, bigrams, extensions and folders, in one pass over the files."""
    of = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("gram"))
    ext = F.filter(F.array(paths.extension(F.col("full_path"))), lambda x: x != "")
    kinds = F.array(F.transform(paths.grams(F.col("folded"), 3), of("tri")), F.transform(paths.grams(F.col("folded"), 2), of("bi")), F.transform(ext, of("ext")), F.array(of("dir")(paths.folder(F.col("full_path")))))
    return files.select("doc_id", F.explode(F.flatten(kinds)).alias("g")).select("g.kind", "g.gram", "doc_id")


def lists(posted: DataFrame) -> DataFrame:
    """The postings as a sorted list of doc_ids for each gram, split by blocks of ids so that no list outgrows a task."""
    block = F.floor(F.col("doc_id") / (1 << 20)).alias("block")
    return posted.groupBy("gram", block).agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def gram_stats(posted: DataFrame) -> DataFrame:
    """One row: grams, fewest, most and average documents of a gram (whole number), and all references. No grams: zeros."""
    sizes = posted.groupBy("gram").agg(F.count("*").alias("docs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    row = sizes.agg(F.count("*").alias("n"), zero(F.min("docs")).alias("min_docs"), zero(F.max("docs")).alias("max_docs"), zero(F.sum("docs")).alias("total_docs_indexed"))
    avg = F.expr("if(n = 0, 0, total_docs_indexed div n)").cast("long").alias("avg_docs")
    return row.select(F.col("n").cast("long").alias("count"), "min_docs", "max_docs", avg, "total_docs_indexed")


def requirement(patterns: list[str], regex: bool):
    """What a path that matches any of the patterns must contain, as strings under All and Any."""
    return either([needed(p) if regex else both([p]) if p else ANYTHING for p in patterns])


def _grams(text: str) -> tuple[str, list[str]] | None:
    text = paths.fold(text)
    n = 3 if len(text) >= 3 else 2
    return ("tri" if n == 3 else "bi", sorted({text[k : k + n] for k in range(len(text) - n + 1)})) if len(text) >= 2 else None


#: So many of a string's grams are looked up, the rarest; a string whose rarest gram more than this share of all files has is not.
LOOKED_UP, MOST_SHARE = 3, 0.25


def candidates(posted: DataFrame, need, sizes: dict[tuple[str, str], int] | None = None, most: float = float("inf")) -> DataFrame | None:
    """doc_ids that may hold what is needed, or None if that says little. posted: (kind, gram, doc_id).

    sizes: how many files have each gram, 0 for those not named; strings whose every gram has more than `most` say little.
    """
    if isinstance(need, str):
        found = _grams(need)
        if found is None or paths.unicodedata.normalize("NFC", need) != need:
            return None
        kind, grams = found
        if sizes is not None:
            grams = sorted(grams, key=lambda g: (sizes.get((kind, g), 0), g))[:LOOKED_UP]
            if sizes.get((kind, grams[0]), 0) > most:
                return None
        some = posted.where((F.col("kind") == kind) & F.col("gram").isin(grams)).groupBy("doc_id").agg(F.count("*").alias("n"))
        return some.where(F.col("n") == len(grams)).select("doc_id")
    parts = [candidates(posted, p, sizes, most) for p in need.parts]
    if isinstance(need, All):
        parts = [p for p in parts if p is not None]
        return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), parts) if parts else None
    return None if any(p is None for p in parts) else reduce(DataFrame.union, parts).distinct()


def _named(need) -> set[tuple[str, str]]:
    if isinstance(need, str):
        found = _grams(need)
        return {(found[0], g) for g in found[1]} if found else set()
    return set().union(*(_named(p) for p in need.parts)) if need.parts else set()


def gram_sizes(grams: DataFrame, need) -> dict[tuple[str, str], int]:
    """How many files have each gram of what is needed: a lookup of as many rows as the patterns have grams."""
    keys = sorted(_named(need))
    if not keys:
        return {}
    kinds = {k: [g for kind, g in keys if kind == k] for k, _ in keys}
    hit = reduce(lambda a, b: a | b, ((F.col("kind") == k) & F.col("gram").isin(g) for k, g in kinds.items()))
    return {(r.kind, r.gram): r.docs for r in grams.where(hit).collect()}


def narrowed(files: DataFrame, posted: DataFrame, patterns: list[str], regex: bool, grams: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """The files that the index cannot rule out. Paths that are not in NFC always stay: folding may part what they hold together.

    grams: (kind, gram, docs), and total: the number of files; with both, common grams are left alone.
    """
    need = requirement(patterns, regex)
    sizes = gram_sizes(grams, need) if grams is not None else None
    found = candidates(posted, need, sizes, MOST_SHARE * total if total is not None else float("inf"))
    if found is None:
        return files
    # one pass over the files: what the index found is marked, and paths out of NFC stay without a mark
    marked = files.join(found.withColumn("hit", F.lit(True)), "doc_id", "left")
    return marked.where("hit or not nfc_ok").select(*files.columns)


def with_extension(files: DataFrame, posted: DataFrame, name: str) -> DataFrame:
    """The files of an extension, by the index."""
    return files.join(posted.where((F.col("kind") == "ext") & (F.col("gram") == name)).select("doc_id"), "doc_id", "left_semi")


def in_folder(files: DataFrame, posted: DataFrame, folder: str, below: bool = False) -> DataFrame:
    """The files that lie right in a folder, or anywhere below it, by the index."""
    folder = folder.rstrip("/")
    hit = (F.col("gram") == folder) | (F.col("gram").startswith(folder + "/") if below else F.lit(False))
    return files.join(posted.where((F.col("kind") == "dir") & hit).select("doc_id"), "doc_id", "left_semi")
