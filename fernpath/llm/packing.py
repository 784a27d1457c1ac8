"""Best-fit packing of token sequences, in bulk-synchronous supersteps.

Pieces are sorted by length over the cluster and ranked. A superstep takes the pieces of one range of lengths, the longest range
first, and all gaps that can hold one of them, sorted and ranked likewise. Pieces and gaps are dealt by rank, so that each shard has
an even share of every size and no two shards want the same gap. Each shard sweeps its pieces, longest first, and gives each the
gap that follows its length most closely, be it one that the sweep itself has left, or a new sequence where none is wide enough.
The gaps that are left are ranked anew for the next range. With one shard this is best-fit decreasing; with several it differs from
that only by what the shards' last sequences leave open.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernpath.llm.bpe import Merger
from fernpath.llm.chunks import Encoder, lasting, load
from fernpath.llm.common import blocks, out, raw, stash, table

MAX_LEN = 4096
END_ID = 1
#: Pieces to a shard, about.
SHARD_ROWS = 1 << 14
#: Ranges of lengths end where they would get this short: halves of max_len, then all that is left.
LEAST_RANGE = 64
#: Chunks with characters from here on are left to the library, since lower case and normal form may depend on what stands around.
FIRST_LEFT = "ɐ"
#: Texts are encoded in blocks of about this many bytes.
TEXT_BYTES = 4 << 20
#: A worker forgets parts of chunks beyond this number; results do not depend on it.
MOST_PARTS = 200_000


class WordEncoder:
    """Ids of white-space chunks in a vocabulary of lower-case words: its pattern parts chunks, equal parts are encoded once."""

    def __init__(self, path: str):
        self.tokenizer, self.merger = load(path), Merger(path)
        # a line feed, which no chunk holds, stands between chunks
        self.find = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.odd = re.compile(f"[{FIRST_LEFT}-\U0010ffff]").search
        self.clear()

    def clear(self) -> None:
        self.known, self.size, self.ids = {"\n": 0}, array("q", [0]), array("I")

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > MOST_PARTS:
            self.clear()
        whole, left = "\n".join(chunks), []
        if self.odd(whole.lower()):
            left = [k for k, c in enumerate(chunks) if self.odd(c.lower())]
            gone = set(left)
            whole = "\n".join("" if k in gone else c for k, c in enumerate(chunks))
        parts, known, piece = self.find(whole.lower()), self.known, self.merger.piece
        for part in set(parts) - known.keys():
            own = piece(part.encode())
            known[part] = len(self.size)
            self.size.append(len(own))
            self.ids.extend(own)
        at = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        size, ids = np.array(self.size, np.int64), np.array(self.ids, np.uint32)
        n, starts = size[at], np.concatenate(([0], np.cumsum(size)))[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.repeat(starts - ends + n, n) + np.arange(total)]
        counts = np.bincount(np.cumsum(at == 0), n, len(chunks)).astype(np.int64)
        if not left:
            return flat, counts
        lists = np.split(flat, np.cumsum(counts)[:-1])
        for k, e in zip(left, self.tokenizer.encode_batch_fast([chunks[k] for k in left], add_special_tokens=False), strict=True):
            lists[k] = np.array(e.ids, np.uint32)
        return np.concatenate(lists), np.array([len(x) for x in lists])


def pieces(docs: DataFrame, path: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's ids; documents over max_len are cut, others stay whole."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            words = WordEncoder(path)
            return Encoder(words.tokenizer, str.split, words)

        encoder = lasting("words", path, made)
        for part in blocks(batches, most=TEXT_BYTES, keep=True):
            rows = []
            texts = [t.decode() for t in part.column("text").to_pylist()]
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.block(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), max_len)):
                    cut = ids[start : start + max_len]
                    rows.append((doc, k, start, len(cut), zlib.crc32(cut.tobytes())))
            yield out(schema, *zip(*rows, strict=True))

    return raw(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(rows: DataFrame, size: str) -> DataFrame:
    """The rows of a written table with `rank`, from 0 on, largest size first; sorted by ranges of sizes, ties in order of the rows."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(n, F.desc(size), "row").sortWithinPartitions(F.desc(size), "row")
    ordered = stash(ordered.select(*rows.columns, F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("place")), "ordered")
    total, before = 0, []
    for r in ordered.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        before.append((r.part, total))
        total += r["count"]
    offsets = spark.createDataFrame(before, "part int, before long")
    return ordered.join(F.broadcast(offsets), "part").select(*rows.columns, (F.col("before") + F.col("place")).alias("rank"))


class Gaps:
    """The open sequences of one shard by free tokens; a bit for each width that some have tells the next one quickly."""

    def __init__(self, capacity: int):
        self.runs: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, free: int, sequence: int) -> None:
        if free:
            self.runs[free].append(sequence)
            self.mask |= 1 << free

    def take(self, length: int) -> tuple[int, int] | None:
        """(free tokens, sequence) of a gap as little wider than `length` as there is, or None."""
        above = self.mask >> length
        if not above:
            return None
        free = length + (above & -above).bit_length() - 1
        found = self.runs[free].pop()
        if not self.runs[free]:
            self.mask ^= 1 << free
        return free, found


_PLACED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def _sweep(step: int, capacity: int):
    """From gaps and pieces of one shard after the other, gaps first, longest pieces first: the pieces' places, and the new gaps (without offset).

    A new sequence's number says in which step and shard it was opened and as which; a shard has about SHARD_ROWS pieces in all.
    """
    schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in _PLACED] + [("free", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps, now, opened, rows = Gaps(capacity), None, 0, []

        def flush():
            nones = [None] * 5
            rows.extend((*nones, sequence, None, free) for free, run_ in enumerate(gaps.runs) for sequence in run_)
            found = out(schema, *zip(*rows, strict=True)) if rows else None
            rows.clear()
            return found

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("shard", "is_piece", "size", "sequence_id", *_PLACED[:3], "ids_crc32")), strict=True):
                shard, is_piece, size, sequence, doc, piece, start, crc = row
                if shard != now:
                    if now is not None and (done := flush()) is not None:
                        yield done
                    gaps, now, opened = Gaps(capacity), shard, 0
                if not is_piece:
                    gaps.add(size, sequence)
                    continue
                free, sequence = gaps.take(size) or (capacity, (step << 58) | (shard << 20) | opened)
                opened += free == capacity
                rows.append((doc, piece, start, size, crc, sequence, capacity - free, None))
                gaps.add(free - size, sequence)
        if now is not None and (done := flush()) is not None:
            yield done

    return run


def place(found: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """The pieces (a written table) with sequence_id and offset."""
    shards = max(1, -(-found.count() // SHARD_ROWS))
    shard = F.pmod("rank", F.lit(shards))
    waiting = stash(ranked(found, "length").select("*", shard.alias("shard")), "waiting")
    ends = [max_len]
    while ends[-1] // 2 >= LEAST_RANGE:
        ends.append(ends[-1] // 2)
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, free long"
    gaps, placed = None, []
    for step, (most, least) in enumerate(zip(ends, [*ends[1:], 0], strict=True)):
        rows = waiting.where((F.col("length") > least) & (F.col("length") <= most)).select("shard", F.lit(True).alias("is_piece"), F.col("length").alias("size"), F.lit(None).cast("long").alias("sequence_id"), *_PLACED[:3], "ids_crc32")
        if gaps is not None:
            wide = ranked(gaps.where(F.col("free") > least), "free").select(shard.alias("shard"), F.lit(False).alias("is_piece"), F.col("free").alias("size"), "sequence_id")
            rows = rows.unionByName(wide, allowMissingColumns=True)
        dealt = rows.repartition("shard").sortWithinPartitions("shard", "is_piece", F.desc("size"), "sequence_id", "doc_id", "piece", "ids_crc32")
        swept = stash(dealt.mapInArrow(_sweep(step, max_len), fields), "swept")
        new = swept.where("free is not null").select("sequence_id", "free")
        gaps = new if gaps is None else new.unionByName(gaps.where(F.col("free") <= least))
        placed.append(swept.where("free is null").select(*_PLACED))
    return reduce(DataFrame.unionByName, placed)


def packed(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """A row for each piece: where it comes from and where it lies. A null text is a document of one id, the end.

    Repeated rows are packed as often as they occur. An empty table gives no rows.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return place(stash(pieces(docs, path, max_len), "pieces"), max_len)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document lies among sequences of at most 4,096 tokens; see `packed` for odd rows."""
    return packed(table(spark, sf_dir, "documents"))
