"""Removal of every byte that lies in a string of WIDTH bytes found elsewhere too.

Each window of WIDTH bytes chooses an anchor, the place of its smallest hash of GRAM bytes; equal windows choose alike, so only
occurrences of one anchor need comparing. A span is the run of windows that share an anchor in a text. A span found twice is
repeated as a whole. Spans that differ although their anchor repeats are compared by sorting what follows and (backwards) what
precedes the anchor; windows are equal where both sides agree far enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernpath.llm.common import blocks, out, release, stash, table
from fernpath.llm.suffix_sort import deep_shallow

WIDTH, GRAM = 200, 32
#: Hash positions that a window chooses from.
CHOICE = WIDTH - GRAM + 1
#: An anchor with more different spans than this is not sorted in one task; its windows are counted one by one all over the cluster.
MOST_SPANS = 20_000
#: Windows of a text that are handled at once; positions within fit the low bits of a sort key.
STRETCH = 1 << 18
_LOW = (1 << 20) - 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes, by joining hashes of halves."""
    h, width = (x.astype(np.uint64) + np.uint64(1)) * _FACTOR, 1
    while width < GRAM:
        h = (h[:-width] * np.uint64(0xD6E8FEB86659FD93 + 2 * width)) ^ (h[width:] + (h[width:] >> np.uint64(29)))
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(31))


def spans(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, first window, last window, anchor position) of each run of windows with one anchor."""
    for start in range(0, max(0, len(data) - WIDTH + 1), STRETCH):
        x = np.frombuffer(data, np.uint8)[start : start + STRETCH + WIDTH - 1]
        h = _gram_hashes(x)
        key = (h & ~np.uint64(_LOW)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= CHOICE:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if rest := CHOICE - width:
            key = np.minimum(key[:-rest], key[rest:])
        at = (key & np.uint64(_LOW)).astype(np.int64)
        first = np.concatenate(([0], np.nonzero(np.diff(at))[0] + 1))
        last = np.append(first[1:], len(at)) - 1
        place = at[first]
        yield from zip(h[place].view(np.int64).tolist(), (first + start).tolist(), (last + start).tolist(), (place + start).tolist(), strict=True)


_SPAN = pa.schema([("anchor", pa.int64()), ("span", pa.int64()), ("d", pa.int64()), ("tk", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32())])


def _keyed(docs: DataFrame) -> DataFrame:
    """d and tk (id and hash of the text: rows alike in both are alike in all that follows) and the text's bytes."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _all_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for part in blocks(batches):
        rows: list[tuple] = []
        for d, tk, data in zip(*(part.column(c).to_pylist() for c in ("d", "tk", "text")), strict=True):
            digest = xxhash.xxh3_64_intdigest
            for anchor, lo, hi, at in spans(data):
                rows.append((anchor, signed(digest(data[lo : hi + WIDTH], at - lo)), d, tk, lo, hi, at))
            if len(rows) > 50_000:
                yield out(_SPAN, *zip(*rows, strict=True))
                rows = []
        if rows:
            yield out(_SPAN, *zip(*rows, strict=True))


_PIECE = pa.schema([("anchor", pa.int64()), ("d", pa.int64()), ("tk", pa.int64()), ("lo", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("hot", pa.bool_()), ("bytes", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted spans of each text."""
    for part in blocks(batches):
        rows = []
        for d, tk, data, wanted in zip(*(part.column(c).to_pylist() for c in ("d", "tk", "text", "wanted")), strict=True):
            rows += [(w["anchor"], d, tk, w["lo"], w["at"], w["n"], w["hot"], data[w["lo"] : w["hi"] + WIDTH]) for w in wanted]
        yield out(_PIECE, *zip(*rows, strict=True))


_RANGE = pa.schema([("d", pa.int64()), ("tk", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])


def repeated_windows(anchor: np.ndarray, before: list[bytes], after: list[bytes]) -> np.ndarray:
    """For each row and each number of bytes before the anchor (0 to CHOICE - 1): whether that window occurs in another row.

    Windows are equal if the bytes before the anchor, read backwards, and those from the anchor on agree as far as the window
    goes. Sorted order and shares give each row its class at every depth.
    """
    n = len(anchor)
    group = np.unique(anchor, return_inverse=True)[1]
    found = np.zeros((n, CHOICE), bool)
    sides = []
    for strings in ([b[::-1] for b in before], after):
        sides.append(deep_shallow(strings, group))
    size = [np.fromiter(map(len, s), np.int64, n) for s in (before, after)]
    for l in range(CHOICE):  # noqa: E741
        whole = (size[0] >= l) & (size[1] >= WIDTH - l)
        if whole.sum() < 2:
            continue
        key = []
        for (order, shared), depth in zip(sides, (l, WIDTH - l), strict=True):
            kind = np.empty(n, np.int64)
            kind[order] = np.cumsum(shared < depth)
            key.append(kind)
        both = key[0][whole] * (n + 1) + key[1][whole]
        _, inverse, times = np.unique(both, return_inverse=True, return_counts=True)
        found[whole, l] = times[inverse] > 1
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of bytes in windows that repeat, for spans found once; rows come sorted by anchor."""

    def ranges(rows: list[tuple]) -> pa.RecordBatch:
        anchor, d, tk, lo, at, n, data = zip(*rows, strict=True)
        cut = [a - l for a, l in zip(at, lo, strict=True)]
        found = repeated_windows(np.array(anchor, np.int64), [b[:c] for b, c in zip(data, cut, strict=True)], [b[c:] for b, c in zip(data, cut, strict=True)])
        single = np.array(n) == 1
        row, left = np.nonzero(found & single[:, None])
        # windows that follow one another make one range; l counts bytes before the anchor, so they run backwards
        begins = np.concatenate(([True], (np.diff(row) != 0) | (np.diff(left) != 1))) if len(row) else np.zeros(0, bool)
        first = np.nonzero(begins)[0]
        last = np.append(first[1:], len(row)) - 1
        at_, d_, tk_ = np.array(at, np.int64), np.array(d, np.int64), np.array(tk, np.int64)
        r = row[first]
        return out(_RANGE, d_[r], tk_[r], at_[r] - left[last], at_[r] - left[first] + WIDTH)

    rows: list[tuple] = []
    for part in blocks(batches, "bytes"):
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if len(rows) >= 4_000 and rows[-1][0] != row[0]:
                yield ranges(rows)
                rows = []
            rows.append(row)
    if rows:
        yield ranges(rows)


_WINDOW = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("d", pa.int64()), ("tk", pa.int64()), ("begin", pa.int32())])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit hash of each window of the spans."""
    for part in blocks(batches, "bytes", 1 << 16):
        rows = []
        for d, tk, lo, data in zip(*(part.column(c).to_pylist() for c in ("d", "tk", "lo", "bytes")), strict=True):
            for k in range(len(data) - WIDTH + 1):
                digest = xxhash.xxh3_128_digest(data[k : k + WIDTH])
                rows.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), d, tk, lo + k))
        yield out(_WINDOW, *zip(*rows, strict=True))


def repeats(docs: DataFrame, most_spans: int | None = None) -> DataFrame:
    """Ranges (d, tk, begin, end) that cover just the bytes to remove; they may overlap and repeat."""
    texts, most_spans = _keyed(docs), most_spans or MOST_SPANS
    schema = "anchor long, span long, d long, tk long, lo int, hi int, at int"
    every = stash(texts.where(F.length("text") >= WIDTH).mapInArrow(_all_spans, schema), "spans")
    # written, so that the joins with them are of plain tables and rows of a hot anchor can be dealt to several tasks
    again = stash(every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("span").alias("a"), F.max("span").alias("b")).where("n > 1").selectExpr("anchor", "a <> b as mixed"), "again")
    shared = stash(every.join(again, "anchor"), "shared")
    release(every, again)
    mixed = shared.where("mixed")
    kinds = mixed.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(F.struct("d", "tk", "lo", "hi", "at")).alias("one"))
    kinds = stash(kinds.select("anchor", "span", "n", "one.*"), "kinds")
    many = stash(kinds.groupBy("anchor").agg((F.count("*") > most_spans).alias("hot")), "many")
    whole = shared.where("not mixed").select("d", "tk", "lo", "hi").unionByName(
        mixed.join(kinds.where("n > 1").select("anchor", "span"), ["anchor", "span"], "left_semi").select("d", "tk", "lo", "hi")
    )
    whole = whole.select("d", "tk", F.col("lo").alias("begin"), (F.col("hi") + WIDTH).alias("end"))
    wanted = kinds.join(many, "anchor")
    # a text's wanted spans are no more than its own spans
    wanted = wanted.groupBy("d", "tk").agg(F.collect_list(F.struct("anchor", "lo", "hi", "at", "n", "hot")).alias("wanted"))
    fields = "anchor long, d long, tk long, lo int, at int, n long, hot boolean, bytes binary"
    pieces = stash(texts.join(wanted, ["d", "tk"]).mapInArrow(_cut, fields), "pieces").dropDuplicates(["anchor", "d", "tk", "lo"])
    sides = pieces.where("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    ranges = "d long, tk long, begin int, end int"
    windows = pieces.where("hot").drop("hot").mapInArrow(_windows, "high long, low long, d long, tk long, begin int")
    twice = windows.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    single = windows.join(twice, ["high", "low"], "left_semi").select("d", "tk", "begin", (F.col("begin") + WIDTH).alias("end"))
    return whole.unionByName(sides.mapInArrow(_compare, ranges)).unionByName(single)


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """The ranges as few that neither touch nor overlap."""
    found: list[list[int]] = []
    for begin, end in sorted((r["begin"], r["end"]) for r in ranges):
        if found and begin <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([begin, end])
    return [tuple(r) for r in found]


def _runs(data: bytes, removed: list[tuple[int, int]]) -> list[bytes]:
    """What lies between the removed ranges."""
    ends = [0, *(e for _, e in removed)]
    return [data[a:b] for a, b in zip(ends, [*(b for b, _ in removed), len(data)], strict=True)]


def cleaned(docs: DataFrame) -> DataFrame:
    """A struct `row` of the documents' own columns, and `ranges`, an array of (begin, end) of bytes to remove, possibly overlapping; null: none.

    Null texts count as empty, and texts shorter than WIDTH have no windows. Repeated rows repeat each other.
    """
    found = stash(repeats(docs), "ranges")
    found = found.groupBy("d", "tk").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    row = F.struct(*(f"`{c}`" for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("tk"))
    return keyed.join(found, ["d", "tk"], "left").select("row", "ranges")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, a row for each row of documents; see `cleaned` for odd rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
        for part in blocks(batches):
            rows = []
            for data, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                removed = _merged(ranges or [])
                kept = b"".join(_runs(data, removed))
                rows.append((len(data), len(data) - len(kept), len(removed), hashlib.sha256(kept).hexdigest()))
            yield out(schema, part.column("doc_id"), *zip(*rows, strict=True))

    found = cleaned(docs.select("doc_id", "text"))
    bytes_ = found.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text").cast("binary"), F.lit(b"")).alias("text"), "ranges")
    return bytes_.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes, n_chars that of the new text. A character cut in part goes as a whole.

    Each kept run is decoded by itself, so that no character arises from bytes of both sides of a cut. Rows, also repeated ones,
    all stay; a text that is removed as a whole stays as an empty one.
    """

    @F.pandas_udf("string")
    def rest(text, ranges):
        import pandas as pd

        cut = (t if r is None or t is None else b"".join(x.decode("utf-8", "ignore").encode() for x in _runs(t.encode(), _merged(list(r)))).decode() for t, r in zip(text, ranges, strict=True))
        return pd.Series(list(cut), dtype=object)

    found = cleaned(docs).select("row", F.when(F.col("ranges").isNull(), F.col("row.text")).otherwise(rest("row.text", "ranges")).alias("rest"))
    new = {"text": F.col("rest"), "n_chars": F.length("rest").cast("long")}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that start anywhere else too; see `cleaned` for odd rows."""
    return digests(table(spark, sf_dir, "documents"))
