"""Language-model scores by context-tree weighting over bytes, beside a plain unigram score over words.

Every byte is eight binary decisions. A decision has a Krichevsky-Trofimov estimate in each context of 0 to DEPTH bytes before it;
the weights with which those estimates mix follow from how well each context's own estimate coded the training texts against the
mixture of the contexts below it. What training gathers are byte n-gram counts and word counts of all training texts.

Contexts longer than TOP bytes are dealt over shards by the TOP + 1 bytes nearest, so that all that lies below such a context is in
one shard. Texts are kept in blocks; a block asks each shard for the probabilities of the n-grams it holds, each of them once, and
the same request brings the shard the block's training counts. Requests are merged, and answered, by groups of blocks, so that what a
task holds is bounded by a group's requests and by the different n-grams of a shard, not by the number of blocks that have them.
Only the contexts of up to TOP bytes are worked out on the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernpath.llm.common import blocks, id_text, most_frequent, out, raw, release, stash, table, tidy

#: Bytes of context in all: a byte and its context fit in 64 bits up to 7.
DEPTH = 5
#: Bytes of context up to which the tree is worked out on the driver: 256 ** TOP contexts at most.
TOP = 2
#: Bytes of text to a block, about how many blocks there are to a shard, the most shards, and the blocks to a group.
TEXT_BYTES, SHARE, MOST_SHARDS, GROUP = 8 << 20, 4, 4096, 512
END = 0
FOLDS, HELD_OUT = 5, 1
#: The most frequent words are sent to all tasks; counts of all others are joined by the word's hash.
HEAD_WORDS = 200_000


def held_out():
    return F.crc32(id_text().cast("binary")) % FOLDS == HELD_OUT


def grams(low: bytes) -> np.ndarray:
    """The number of each byte with the TOP bytes before it: the text, then an end; ends stand before the first byte."""
    x = np.frombuffer(bytes([END]) * TOP + low + bytes([END]), np.uint8).astype(np.uint32)
    code = x[: len(x) - TOP]
    for k in range(1, TOP + 1):
        code = (code << 8) | x[k : len(x) - TOP + k]
    return code


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def gather(texts: DataFrame) -> DataFrame:
    """Rows (kind, key, n) of hashed words (kind 1) and ends (kind 2), summed over all texts given."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Counter()

        def flush():
            found = out(schema, np.ones(len(words), np.int32), np.array([word_hash(w) for w in words], np.int64), np.fromiter(words.values(), np.int64, len(words)))
            words.clear()
            return found

        ends = 0
        for part in blocks(batches):
            for data in part.column("text").to_pylist():
                words.update(data.lower().split())
                ends += 1
            if len(words) > 300_000:
                yield flush()
        yield flush()
        yield out(schema, [2], [0], [ends])

    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


_SMALL = 4096
_HALF = np.array([math.lgamma(n + 0.5) for n in range(_SMALL)])
_WHOLE = np.array([math.lgamma(n + 1.0) for n in range(_SMALL)])


def _log_gamma(n: np.ndarray, plus: float, known: np.ndarray) -> np.ndarray:
    x = n + plus
    found, far = known[np.minimum(n, _SMALL - 1).astype(np.int64)], n >= _SMALL
    x = x[far]
    found[far] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return found


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimate gives to a zeros and b ones."""
    return _log_gamma(a, 0.5, _HALF) + _log_gamma(b, 0.5, _HALF) - _log_gamma(a + b, 1.0, _WHOLE) - math.log(math.pi)


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From counts of the 256 bytes (last axis): zeros and ones at each of the 255 inner nodes of the tree over a byte's bits."""
    zeros, ones, level = [], [], counts.astype(np.float64)
    while level.shape[-1] > 1:
        pair = level.reshape(*level.shape[:-1], -1, 2)
        zeros.insert(0, pair[..., 0])
        ones.insert(0, pair[..., 1])
        level = pair.sum(axis=-1)
    return np.concatenate(zeros, axis=-1), np.concatenate(ones, axis=-1)


class Tree:
    """The weighted tree: for each context that occurred, log10 of the probability of each byte.

    deeper: if there are longer contexts, what they give at the longest ones here, as log probabilities by context and decision.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, deeper: tuple[np.ndarray, np.ndarray] | None = None):
        context, byte = key >> 8, key & 255
        own, row = np.unique(context, return_inverse=True)
        counts = np.zeros((len(own), 256))
        np.add.at(counts, (row, byte), n)
        levels = [(own, counts)]  # from the longest contexts to the empty one
        for _ in range(TOP):
            # the context without its oldest byte: older bytes are the higher ones
            length = TOP - len(levels) + 1
            shorter, up = np.unique(levels[-1][0] & ((1 << (8 * (length - 1))) - 1), return_inverse=True)
            total = np.zeros((len(shorter), 256))
            np.add.at(total, up, levels[-1][1])
            levels.append((shorter, total))
        below, weight = None, []
        for k, (contexts, total) in enumerate(levels):
            zeros, ones = _decisions(total)
            own_log = _log_kt(zeros, ones)
            if below is None and deeper is not None:
                split = np.zeros(own_log.size)
                split[np.searchsorted(contexts, deeper[0] // 255) * 255 + deeper[0] % 255] = deeper[1]
                split = split.reshape(own_log.shape)
                mixed = np.logaddexp(own_log, split) - math.log(2)
                stop = np.exp(own_log - math.log(2) - mixed)
            elif below is None:
                mixed, stop = own_log, np.ones_like(own_log)
            else:
                mask = (1 << (8 * (TOP - k))) - 1
                split = np.zeros_like(own_log)
                np.add.at(split, np.searchsorted(contexts, levels[k - 1][0] & mask), below)
                mixed = np.logaddexp(own_log, split) - math.log(2)
                stop = np.exp(own_log - math.log(2) - mixed)
            weight.append((stop, (ones + 0.5) / (zeros + ones + 1)))
            below = mixed
        self.contexts = [c for c, _ in levels]
        self.costs = [np.zeros(0)] * len(levels)
        self.reach = [(np.zeros(0), np.zeros(0))] * len(levels)
        reach = None  # on the way from the empty context down: the weight not yet given, and the probability of a one so far
        for k in range(len(levels) - 1, -1, -1):
            stop, one = weight[k]
            if reach is None:
                reach = (1 - stop, stop * one)
            else:
                up = np.searchsorted(levels[k + 1][0], levels[k][0] & ((1 << (8 * (TOP - k - 1))) - 1))
                reach = (reach[0][up] * (1 - stop), reach[1][up] + reach[0][up] * stop * one)
            self.reach[k] = reach
            # what is left goes to deeper contexts that never occurred, where both outcomes are alike
            self.costs[k] = self._bytes(reach[1] + reach[0] * 0.5)

    @staticmethod
    def _bytes(one: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte from the probability of a one at each of the 255 decisions."""
        one = np.clip(one, 1e-12, 1 - 1e-12)
        bit = np.log10(np.stack([1 - one, one], axis=-1))
        level = bit[..., 0, :]
        for k in range(1, 8):
            nodes = bit[..., (1 << k) - 1 : (1 << (k + 1)) - 1, :]
            level = (level[..., :, None] + nodes).reshape(*level.shape[:-1], -1)
        return level

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every possible context the row of its longest known suffix, and the rows."""
        every, first = np.zeros(256**TOP, np.int32), np.cumsum([0, *(len(c) for c in self.contexts)])
        for k in range(TOP, -1, -1):
            mask = (1 << (8 * (TOP - k))) - 1
            suffix = np.arange(256**TOP) & mask
            at = np.minimum(np.searchsorted(self.contexts[k], suffix), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == suffix
            every[known] = first[k] + at[known]
        return every, np.concatenate(self.costs).astype(np.float32)


def _codes(texts: list[bytes]) -> np.ndarray:
    """Each byte with the DEPTH bytes before it, the nearest in the highest place; the text, then an end, and ends before it."""
    x = np.frombuffer(b"".join(bytes([END]) * DEPTH + t + bytes([END]) for t in texts), np.uint8)
    code = x[DEPTH:].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        code |= x[DEPTH - k : len(x) - k].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - k))
    inside = np.ones(len(code), bool)  # not the ends before each text but the first
    first = np.cumsum([len(t) + DEPTH + 1 for t in texts])[:-1] - DEPTH
    for k in range(DEPTH):
        inside[first + k] = False
    return code[inside]


def _stretches(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, lengths, codes): all texts at once, or a text longer than a block bit by bit."""
    if len(texts) > 1 or len(texts[0]) <= TEXT_BYTES:
        yield 0, np.array([len(t) + 1 for t in texts]), _codes(texts)
        return
    for start in range(0, len(texts[0]) + 1, TEXT_BYTES):
        before = max(0, start - DEPTH)
        code = _codes([texts[0][before : start + TEXT_BYTES]])[start - before :]
        code = code if start + TEXT_BYTES > len(texts[0]) else code[:-1]
        yield 0, np.array([len(code)]), code


def _shard(code: np.ndarray, shards: int) -> np.ndarray:
    near = code >> np.uint64(8 * (DEPTH - TOP))
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)


def _pack(code: np.ndarray, n: np.ndarray, width: int = 4) -> bytes:
    """Ascending codes as differences, and counts of `width` bytes, byte planes apart; compressed."""
    step = np.diff(code, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    plain = step.tobytes() + n.astype(f"u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return len(code).to_bytes(8, "little") + bytes([width]) + pa.Codec("zstd", 1).compress(plain, asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, width = int.from_bytes(data[:8], "little"), data[8]
    plain = np.frombuffer(pa.Codec("zstd").decompress(data[9:], (8 + width) * size, asbytes=True), np.uint8)
    step = np.ascontiguousarray(plain[: 8 * size].reshape(8, size).T).view(np.uint64).ravel()
    return np.cumsum(step, dtype=np.uint64), np.ascontiguousarray(plain[8 * size :].reshape(width, size).T).view(f"u{width}").ravel()


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending and each once, with their counts summed."""
    code, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in found]), len(code))


def _blocks(texts: DataFrame) -> DataFrame:
    """A row for each block: number, and the doc_id, held_out and text of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.binary())]))
        schema, number, rows, size = pa.schema([("block", pa.int64()), ("docs", kind)]), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if rows and size + len(row["text"]) > TEXT_BYTES:
                    yield out(schema, [number], [rows])
                    number, rows, size = number + 1, [], 0
                rows.append(row)
                size += len(row["text"]) + 1
        if rows:
            yield out(schema, [number], [rows])

    return texts.mapInArrow(run, "block long, docs array<struct<doc_id:long,held_out:boolean,text:binary>>")


def _requests(shards: int):
    """From blocks: for each shard the codes that occur in the block, with their counts in training texts."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, docs in _rows(batches, "block", "docs"):
            texts, found = [d["text"].lower() for d in docs], []
            trains = np.array([not d["held_out"] for d in docs])
            for _, length, code in _stretches(texts):
                code = np.sort((code << np.uint64(1)) | np.repeat(trains, length).astype(np.uint64))
                own = code >> np.uint64(1)
                start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                found.append((own[start], np.add.reduceat((code & np.uint64(1)).astype(np.int64), start)))
            code, n = found[0] if len(found) == 1 else _merged(found)
            to = _shard(code, shards)
            for k in np.unique(to).tolist():
                yield out(schema, [k], [block], [_pack(code[to == k], n[to == k])])

    return run


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(name)[k].as_py() for name in names)


class Deep:
    """The part of the tree in one shard: contexts of TOP + 1 to DEPTH bytes. Codes with no count stand for what is only asked."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.levels = [(code, n.astype(np.float64), None)]  # with the number of the element that each becomes one level up
        for _ in range(DEPTH - TOP - 1):
            longer, count, _ = self.levels[-1]
            shorter, up = np.unique(((longer >> np.uint64(16)) << np.uint64(8)) | (longer & np.uint64(255)), return_inverse=True)
            self.levels[-1] = (longer, count, up)
            self.levels.append((shorter, np.bincount(up, count, len(shorter)), None))
        near = self.levels[-1][0] >> np.uint64(16)
        self.context = (((near & np.uint64(255)) << np.uint64(8)) | (near >> np.uint64(8))).astype(np.int64)
        self.byte = (self.levels[-1][0] & np.uint64(255)).astype(np.int64)

    def _up(self, bit: int) -> tuple[list, np.ndarray]:
        """Of the decisions on one bit, by level from the longest contexts: first elements, each element's node, weight of stopping and probability of a one."""
        found, below = [], None
        for k, (code, count, _) in enumerate(self.levels):
            node = code >> np.uint64(8 - bit)
            new = np.concatenate(([True], node[1:] != node[:-1]))
            start, node = np.flatnonzero(new), np.cumsum(new) - 1
            ones = np.add.reduceat(count * ((code >> np.uint64(7 - bit)) & np.uint64(1)), start)
            total = np.add.reduceat(count, start)
            own = _log_kt(total - ones, ones)
            if below is None:
                below, stop = own, np.ones_like(own)
            else:
                split = np.bincount(node[self.levels[k - 1][2][found[-1][0]]], below, len(start))
                below = np.logaddexp(own, split) - math.log(2)
                stop = np.exp(own - math.log(2) - below)
            found.append((start, node, stop, (ones + 0.5) / (total + 1)))
        return found, np.where(total > 0, below, 0.0)

    def _decision(self, bit: int, at: np.ndarray) -> np.ndarray:
        return (1 << bit) - 1 + (self.byte[at] >> (8 - bit))

    def upward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the tree above needs: n-grams of TOP + 1 bytes and their counts; decisions there and the sum of what lies below them."""
        gram, at = np.unique(self.context << 8 | self.byte, return_inverse=True)
        n, keys, sums = np.bincount(at, self.levels[-1][1], len(gram)), [], []
        for bit in range(8):
            found, mixed = self._up(bit)
            start = found[-1][0]
            key, at = np.unique(self.context[start] * 255 + self._decision(bit, start), return_inverse=True)
            keys.append(key)
            sums.append(np.bincount(at, mixed, len(key)))
        key, total = np.concatenate(keys), np.concatenate(sums)
        return gram[n > 0], n[n > 0], key[total != 0], total[total != 0]

    def costs(self, every: np.ndarray, left: np.ndarray, one: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's byte, from the weight not yet given and the probability so far at the contexts of TOP bytes."""
        cost = np.zeros(len(self.levels[0][0]))
        for bit in range(8):
            found, _ = self._up(bit)
            start = found[-1][0]
            row, decision = every[self.context[start]], self._decision(bit, start)
            reach = left[row, decision], one[row, decision]
            for k in range(len(found) - 1, -1, -1):
                start, node, stop, part = found[k]
                if k < len(found) - 1:
                    up = found[k + 1][1][self.levels[k][2][start]]
                    reach = reach[0][up], reach[1][up]
                reach = reach[0] * (1 - stop), reach[1] + reach[0] * stop * part
            ends = np.clip(reach[1] + reach[0] * 0.5, 1e-12, 1 - 1e-12)
            ends = np.log10(np.stack([1 - ends, ends], axis=1))
            cost += ends[found[0][1], ((self.levels[0][0] >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)]
        return cost


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (shard, parts) with the codes and counts of parts: those of the whole row."""
    schema = pa.schema([("shard", pa.int32()), ("data", pa.binary())])
    for shard, parts in _rows(batches, "shard", "parts"):
        yield out(schema, [shard], [_pack(*_merged([_unpack(p["data"]) for p in parts]), 8)])


def _upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("x", pa.float64())])
    for (data,) in _rows(batches, "data"):
        gram, n, key, x = Deep(*_unpack(data)).upward()
        yield out(schema, np.repeat([0, 1], [len(gram), len(key)]), np.concatenate([gram, key]), np.concatenate([n, x]))


def _costs(shared):
    """From shards: their codes, and what each costs."""
    schema = pa.schema([("shard", pa.int32()), ("data", pa.binary()), ("cost", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, data in _rows(batches, "shard", "data"):
            yield out(schema, [shard], [data], [Deep(*_unpack(data)).costs(*shared.value[:3]).astype(np.float32).tobytes()])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From groups of blocks and the shard they ask: for each block the costs of the codes that it asked for, in their order."""
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])
    for shard, parts, data, cost in _rows(batches, "shard", "parts", "data", "cost"):
        code, cost = _unpack(data)[0], np.frombuffer(cost, np.float32)
        for p in parts:
            yield out(schema, [p["block"]], [shard], [cost[np.searchsorted(code, _unpack(p["data"])[0])].tobytes()])


def _block_scores(texts: list[bytes], answers: list[dict], shards: int) -> np.ndarray:
    """The score of each text of a block."""
    told = {a["shard"]: np.frombuffer(a["data"], np.float32) for a in answers}
    kinds = []
    for _, length, code in _stretches(texts):
        found = pa.array(code).dictionary_encode()
        own = found.dictionary.to_numpy()
        order = np.argsort(own)
        kinds.append((own[order], order, found.indices.to_numpy(), length))
    every = kinds[0][0] if len(kinds) == 1 else np.unique(np.concatenate([own for own, *_ in kinds]))
    cost, to, score = np.zeros(len(every), np.float32), _shard(every, shards), np.zeros(len(texts))
    for k, values in told.items():
        cost[to == k] = values
    for own, order, at, length in kinds:
        here = np.empty(len(own))
        here[order] = cost[np.searchsorted(every, own)]
        here = here[at]
        score += np.add.reduceat(here, np.concatenate(([0], np.cumsum(length)[:-1])))
    return score


def top(shards: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each context of TOP bytes the row of its longest known suffix; by row and decision the weight not yet given and the probability of a one so far."""
    sums = stash(shards.mapInArrow(_upward, "kind int, key long, x double").groupBy("kind", "key").agg(F.sum("x").alias("x")), "top")
    gram, deeper = (sums.where(F.col("kind") == k).select("key", "x").toPandas() for k in (0, 1))  # 256 ** (TOP + 1) rows at most each
    if not len(gram):
        return np.zeros(256**TOP, np.int32), np.ones((1, 255)), np.zeros((1, 255))
    tree = Tree(gram["key"].to_numpy(np.int64), gram["x"].to_numpy(np.float64), (deeper["key"].to_numpy(np.int64), deeper["x"].to_numpy(np.float64)))
    return tree.table()[0], *(np.concatenate([r[k] for r in tree.reach]) for k in (0, 1))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte, a row for each row of documents.

    bits_per_byte is the code length that the score stands for, by the bytes of the text and its end.

    A null text counts as empty: it is one token, its end, for the words, and one end byte for the tree. Repeated rows train as
    often as they occur. Without training texts every word is unknown and every byte's bits are even.
    """
    spark = docs.sparkSession
    held = stash(_blocks(raw(docs, held_out().alias("held_out"))), "blocks")
    blocks_ = held.count()
    shards, groups = max(12, min(MOST_SHARDS, blocks_ // SHARE)), -(-blocks_ // GROUP) or 1
    asked = held.mapInArrow(_requests(shards), "shard int, block long, data binary").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)))
    asked = stash(asked.repartition(shards, "shard", "part").groupBy("shard", "part").agg(F.collect_list(F.struct("block", "data")).alias("parts")), "asked")
    merged = asked.mapInArrow(_merge, "shard int, data binary").groupBy("shard").agg(F.collect_list(F.struct("data")).alias("parts"))
    merged = stash(merged.mapInArrow(_merge, "shard int, data binary"), "shards")
    tree = top(merged)
    counts = stash(gather(raw(docs.where(~held_out()))), "counts")
    words = counts.where("kind = 1").select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = (counts.where("kind = 2").agg(F.sum("n").alias("n")).first().n) or 0
    n_all, vocabulary = int(total.n) + int(ends), int(total.v) + (ends > 0)
    head, bound = most_frequent(words, HEAD_WORDS)
    head = head.toPandas().sort_values("key")
    shared = spark.sparkContext.broadcast((*tree, head["key"].to_numpy(np.int64), head["n"].to_numpy(np.int64)))
    log_all = math.log10(n_all + 0.5 * (vocabulary + 1))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64()), ("rare", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = shared.value[3:]
        part_of = np.append(np.log10(n + 0.5) - log_all, math.nan)
        end = math.log10(ends + 0.5) - log_all
        for docs, told in _rows(batches, "docs", "told"):
            texts = [d["text"].lower() for d in docs]
            score = _block_scores(texts, told, shards)
            parts = pa.compute.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
            kinds = parts.values.dictionary_encode()
            own = kinds.dictionary.cast(pa.large_binary()).to_pylist()
            hashed = (np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)) ^ np.uint64(1 << 63)).view(np.int64)  # as word_hash()
            place = np.minimum(np.searchsorted(key, hashed), max(len(key) - 1, 0))
            empty = np.array([w == b"" for w in own], bool)  # before the first gap and behind the last stands an empty word
            head = key[place] == hashed if len(key) else np.zeros(len(own), bool)
            value = np.where(empty, 0.0, part_of[np.where(head, place, len(key))])  # not a number for a word outside the head
            at = kinds.indices.to_numpy()
            real = ~empty[at]
            text = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
            value, rare = value[at], np.isnan(value)[at]
            total = np.bincount(text, real, len(texts)).astype(np.int64)
            n_rare = np.bincount(text, rare, len(texts)).astype(np.int64)
            base = np.bincount(text, np.where(rare, 0.0, value), len(texts)) + end
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_rare))), pa.int32()), pa.array(hashed[at][rare], pa.int64()))
            columns = [[d["doc_id"] for d in docs], [d["held_out"] for d in docs], total + 1, total - n_rare + (ends > 0), base, score, -score * math.log2(10) / np.array([len(t) + 1 for t in texts])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema)), lists], schema=schema)

    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double, rare array<long>"
    costs = merged.mapInArrow(_costs(shared), "shard int, data binary, cost binary")
    told = asked.join(costs, "shard").select("shard", "parts", "data", "cost").mapInArrow(_answers, "block long, shard int, data binary")
    told = stash(told.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias("told")), "told")
    release(asked, merged)
    tidy(spark)  # the last plan moves all texts once
    found = held.join(told, "block").select("docs", "told").mapInArrow(run, fields)
    if len(head) == total.v:  # then a word outside the head did not occur in training
        unknown = F.lit(math.log10(0.5) - log_all) * F.size("rare")
        return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).alias("train_tokens"), (F.col("base_score") + unknown).alias("base_score"), "score", "bits_per_byte")
    found = stash(found.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = words.where(F.col("n") < bound).withColumnsRenamed({"key": "word", "n": "c"})
    rare = found.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times")).join(rest, "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)) - F.lit(log_all))).alias("part"),
    )
    joined = found.drop("rare").join(rare, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("part", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte",
    )


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and byte scores of every document; see `scores` for odd rows."""
    return scores(table(spark, sf_dir, "documents"))
