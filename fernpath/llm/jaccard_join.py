"""Links between texts whose sets of word shingles have a high Jaccard similarity, and the groups those links make.

Texts with equal sets are one class; everything below works on classes. Shingles have one order for all classes: those that fewest
classes have come first. A class is indexed by a prefix of its shingles in that order: rare ones one by one, frequent ones by pairs
that fall in the same cell, since one frequent shingle says little. The prefix is extended until no more shingles than two similar
sets may differ by can spoil all of its entries, so that similar sets share an entry. Shingles that one class alone has fill a
prefix without making entries.

That first index is built from a fraction of the shingles, and each class is compared with one leader of each of its entries. Classes
that share an entry but that no link has brought together are indexed again, now by all their shingles, counted among those classes.
They too are compared with leaders first. Those still apart are paired where they share a shingle of their prefixes that comes early
enough in both, as one of two similar sets must: hardly any other pair has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernpath.llm.common import blocks, out, raw, release, stash, table
from fernpath.llm.links import components

WIDTH, PERCENT = 3, 90
#: A shingle that more classes have is frequent.
FREQUENT = 40
#: Up to so many ids are sent to all tasks to pick documents; beyond it a shuffle join picks them.
MOST_IDS = 2_000_000
#: Stands for a null doc_id inside.
NO_ID = -(1 << 63)
#: A cell holds this many frequent shingles of a set that has just reached the cell's size class.
CELL = 6

_A, _B, _C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; words are hashed once each."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, data: bytes) -> np.ndarray:
        words, known = data.lower().split(), self.known
        if len(known) > 300_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        width = min(self.width, len(h))
        total = np.full(len(h) - width + 1, np.uint64(width))
        for k in range(width):
            total = _mix(total * _A + h[k : len(h) - width + 1 + k])
        return np.unique(total)


class Scheme:
    """How sets are indexed for links of `percent` hundredths or more."""

    def __init__(self, percent: int):
        self.percent = percent
        #: Shingles with hashes below are counted, and a set's index entries come from them where they suffice.
        self.cut = np.uint64(int(min(1.0, 2 * (100 - percent) / 100) * (2**64 - 1)))
        #: Smaller sets are linked with equal ones only.
        self.least = -(-percent // (100 - percent)) if percent < 100 else 1 << 60

    def spare(self, n: int) -> int:
        """So many of n shingles may be missing from a similar set."""
        return n - -(-self.percent * n // 100)

    def classes(self, n: int) -> list[int]:
        """Size classes in which a set of n may meet a similar set that is no smaller."""
        return list(range(n.bit_length(), (100 * n // self.percent).bit_length() + 1))

    def cells(self, size_class: int) -> int:
        return max(1, int((1 << (size_class - 1)) * 2 * (100 - self.percent) / 100 / CELL))

    def parts(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counted shingles, and those others that fill a prefix if all counted ones are frequent and share too few cells."""
        n, low = len(tokens), tokens[: np.searchsorted(tokens, self.cut)]
        if n < self.least:
            return tokens[:0], tokens[:0]
        gain = min(len(low) - len(np.unique(self._cell(low, c))) for c in self.classes(n))
        return low, tokens[len(low) : len(low) + max(0, self.spare(n) + 1 - gain)]

    def _cell(self, tokens: np.ndarray, size_class: int) -> np.ndarray:
        return (_mix(tokens) >> np.uint64(16)) % np.uint64(self.cells(size_class))

    def entries(self, n: int, alone: int, times: np.ndarray, tokens: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index entries of a set of n shingles, and how many shingles come before each in the common order.

        alone: how many counted shingles no other class has; tokens: the other counted ones, and how many classes have them;
        more: what may follow them.
        """
        left = self.spare(n) + 1 - alone
        if left <= 0:
            return tokens[:0], np.zeros(0, np.int64)
        often = times > FREQUENT
        rare = tokens[~often][np.lexsort((tokens[~often], times[~often]))][:left]
        found, place = [_mix(rare + _A)], [alone + np.arange(len(rare))]
        if (left := left - len(rare)) > 0:
            some, first = np.sort(tokens[often]), alone + len(rare)
            for c in self.classes(n):
                cell = self._cell(some, c)
                by = np.argsort(cell, kind="stable")
                new = np.ones(len(some), bool)  # the first of its cell adds nothing: alone it makes no pair
                new[by[1:]] = cell[by[1:]] != cell[by[:-1]]
                gain = np.cumsum(~new)
                if len(gain) and gain[-1] >= left:
                    end = int(np.searchsorted(gain, left)) + 1
                else:
                    end, rest = len(some), left - (int(gain[-1]) if len(gain) else 0)
                    found.append(_mix(more[:rest] + _A))
                    place.append(first + len(some) + np.arange(len(found[-1])))
                by = by[by < end]
                some_, cell_, step = some[by], cell[by], 1
                while step < len(by) and (same := cell_[step:] == cell_[:-step]).any():
                    found.append(_mix(some_[:-step][same] * _B + _mix(some_[step:][same]) + np.uint64(c)))
                    place.append(first + by[step:][same])
                    step += 1
        found, at = np.unique(np.concatenate(found), return_index=True)
        return found, np.concatenate(place)[at]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)))


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def sets(docs: DataFrame, width: int, scheme: Scheme) -> DataFrame:
    """For each row: doc_id, tk (hash of the text), n (size of the set), hi and lo (its digest), tokens (counted ones), more and sketch.

    sketch holds 32 bits of each shingle with a hash below half the scheme's cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, half = Shingler(width), scheme.cut >> np.uint64(1)
        for part in blocks(batches):
            every = [shingles(t) for t in part.column("text").to_pylist()]
            high, low = zip(*map(_digest, every), strict=True)
            kept, more = zip(*map(scheme.parts, every), strict=True)
            sketch = [np.unique(t[: np.searchsorted(t, half)].astype(np.uint32)).tobytes() for t in every]
            columns = [part.column("doc_id"), part.column("tk"), pa.array([len(t) for t in every], pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), _lists(kept), _lists(more), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tk", "n", "hi", "lo", "tokens", "more", "sketch"])

    return raw(docs, _text_key().alias("tk")).mapInArrow(run, "doc_id long, tk long, n long, hi long, lo long, tokens array<long>, more array<long>, sketch binary")


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _full(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(c, tokens) of the classes (c, rep) given, all their shingles, read from the texts of the rows with the ids rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for part in blocks(batches):
            every = [shingles(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(t)[1] for t in every], pa.int64()), _lists(every)], names=["c", "tokens"])

    wanted = classes.select(F.col("rep").alias("doc_id")).distinct()
    if wanted.count() <= MOST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    return raw(texts).mapInArrow(run, "c long, tokens array<long>").dropDuplicates(["c"])


def _entries(scheme: Scheme) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("entry", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = [part.column(k).flatten().to_numpy() for k in ("times", "tokens", "more")]
                lists[1:] = [x.view(np.uint64) for x in lists[1:]]
                ends = [np.concatenate(([0], np.cumsum(pa.compute.list_value_length(part.column(k)).to_numpy()))) for k in ("times", "tokens", "more")]
                n, alone, c = (part.column(k).to_numpy() for k in ("n", "alone", "c"))
                found = [scheme.entries(int(n[k]), int(alone[k]), *(x[e[k] : e[k + 1]] for x, e in zip(lists, ends, strict=True))) for k in range(len(n))]
                size = [len(x) for x, _ in found]
                yield out(schema, _signed(np.concatenate([x for x, _ in found])), np.repeat(c, size), np.repeat(n, size), np.concatenate([p for _, p in found]))

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted arrays without repeats have in common."""
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _near(percent: int) -> callable:
    """Drops pairs whose sketches differ by more than two similar sets differ as a whole; no similar pair is among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("nx", "ny", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                keep.append((100 + percent) * (len(x) + len(y) - 2 * _shared(x, y)) <= (100 - percent) * (n + m))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those whose sets are similar enough."""
    node = classes.select("c", "n", "sketch")
    told = pairs.join(node.withColumnsRenamed({"c": "a", "n": "nx", "sketch": "x"}), "a").join(node.withColumnsRenamed({"c": "b", "n": "ny", "sketch": "y"}), "b")
    pairs = stash(told.select("a", "b", "nx", "ny", "x", "y").mapInArrow(_near(percent), "a long, b long").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    wanted = stash(classes.select("c", "rep").join(wanted, "c", "left_semi"), "wanted")
    full = stash(_full(docs, wanted, width), "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part, rows = batch.slice(start, 200), []
                for a, b, x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("x"), part.column("y"), strict=True):
                    x, y = x.values.to_numpy(), y.values.to_numpy()
                    both = _shared(x, y)
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        rows.append((a, b))
                yield out(schema, *(zip(*rows, strict=True) if rows else ([], [])))

    x, y = full.select(F.col("c").alias("a"), F.col("tokens").alias("x")), full.select(F.col("c").alias("b"), F.col("tokens").alias("y"))
    found = stash(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified")
    release(pairs, wanted, full)
    return found


def _first_index(classes: DataFrame, scheme: Scheme) -> DataFrame:
    """(entry, c, n, pos): entries of all classes from their counted shingles, those that one class alone has left out."""
    each = classes.select("c", F.explode("tokens").alias("t"))
    # written, here and below, so that its shuffle files go before the next ones come, and rows of a hot key can be dealt to many tasks
    times = stash(each.groupBy("t").agg(F.count("*").cast("int").alias("times")).where("times > 1"), "times")
    many = each.join(times, "t").groupBy("c").agg(F.collect_list(F.struct("times", "t")).alias("s"))
    many = many.join(classes.select("c", "n", F.size("tokens").alias("low"), "more"), "c")
    many = many.selectExpr("c", "n", "cast(low - size(s) as bigint) as alone", "s.times as times", "s.t as tokens", "more")
    found = many.mapInArrow(_entries(scheme), "entry long, c long, n long, pos long")
    # classes whose counted shingles are all their own can still meet in what follows them
    rest = classes.where(F.size("more") > 0).join(many.select("c"), "c", "left_anti")
    rest = rest.selectExpr("c", "n", "cast(size(tokens) as bigint) as alone", "cast(array() as array<int>) as times", "cast(array() as array<bigint>) as tokens", "more")
    found = stash(found.unionByName(rest.mapInArrow(_entries(scheme), "entry long, c long, n long, pos long")), "index")
    release(times)
    return found


def _second_index(docs: DataFrame, some: DataFrame, width: int, percent: int) -> DataFrame:
    """(entry, c, n, pos): the prefixes of the classes (c, n, rep) given, all their shingles counted among those classes."""
    full = stash(_full(docs, some, width).join(some.select("c", "n"), "c"), "whole")
    each = full.select("c", "n", F.explode("tokens").alias("t"))
    times = stash(each.groupBy("t").agg(F.count("*").alias("times")).where("times > 1"), "times")
    many = each.join(times, "t").groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("times", "t"))).alias("s"))
    # at most n - ceil(percent n / 100) shingles of a set are missing from a similar one
    many = many.selectExpr("c", "n", "s", "n - size(s) as alone", f"cast(n - ceil({percent} * n / 100) + 1 - (n - size(s)) as int) as fill").where("fill > 0")
    found = many.select("c", "n", "alone", F.posexplode(F.expr("transform(slice(s, 1, fill), x -> x.t)")).alias("k", "entry"))
    found = stash(found.selectExpr("entry", "c", "n", "alone + k as pos"), "second")
    release(full, times)
    return found


def _apart(index: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of an index (entry, c, n, pos, root) that lie in different groups and may yet be similar.

    The largest side of an entry is never paired with itself. Where two similar sets first share a shingle of the common order,
    what either has before it is missing from the other.
    """
    sides = index.groupBy("entry", "root").count().groupBy("entry").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("sides")).where("sides > 1")
    sides = stash(sides, "sides")
    placed = index.join(sides.select("entry", "main"), "entry")
    side = lambda x: [F.col(k).alias(k + x) for k in ("c", "n", "root", "pos")]
    few, every = placed.where("root <> main").select("entry", *side("x")), placed.select("entry", "main", *side("y"))
    need = f"ceil({percent} * (nx + ny) / {100 + percent})"
    near = f"100 * least(nx, ny) >= {percent} * greatest(nx, ny) and posx <= nx - {need} and posy <= ny - {need}"
    pairs = few.join(every, "entry").where(f"rootx <> rooty and (rooty = main or cx < cy) and {near}")
    return pairs.select(F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b")).distinct()


def _led(index: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each entry's leader and the entry's other classes.

    The class with the fewest rarer shingles leads: what is common to a group is all it has.
    """
    leads = index.groupBy("entry").agg(F.min(F.struct("pos", F.expr("-n as less"), "c")).alias("lead"), F.count("*").alias("times")).where("times > 1")
    met = index.join(stash(leads.selectExpr("entry", "-lead.less as ln", "lead.c as a"), "leads"), "entry")
    return met.where(f"c <> a and 100 * least(ln, n) >= {percent} * greatest(ln, n)").select("a", F.col("c").alias("b")).distinct()


def _rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(c, n, rep, root) of all classes, root the smallest class that links lead to."""
    return classes.select("c", "n", "rep").join(components(links), F.col("c") == F.col("node"), "left").select("c", "n", "rep", F.coalesce("label", "c").alias("root"))


def _split(index: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of (c, n, rep, root) whose class shares an entry with a class of another root."""
    placed = index.select("entry", "c").join(rooted, "c")
    split = stash(placed.groupBy("entry").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("entry"), "split")
    return stash(placed.join(split, "entry", "left_semi").select("c", "n", "rep", "root").distinct(), "apart")


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tk, n, c) of each row, c the class of its set, and (node, label) of the classes that have links."""
    scheme = Scheme(percent)
    stored = stash(sets(docs, width, scheme), "sets")
    classes = stored.where("n > 0").groupBy("hi", "lo", "n").agg(
        F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("rep"), *(F.first(k).alias(k) for k in ("tokens", "more", "sketch"))
    )
    classes = stash(classes.withColumnRenamed("lo", "c").drop("hi"), "classes")
    rows = stash(stored.selectExpr("doc_id", "tk", "n", "if(n > 0, lo, null) as c"), "rows")
    release(stored)
    index = _first_index(classes.where(f"n >= {scheme.least}"), scheme)
    first = _verify(docs, _led(index, percent), classes, width, percent)
    # classes that are still apart although they share an entry
    some = _split(index, _rooted(classes, first))
    release(index)
    index = _second_index(docs, some, width, percent)
    second = _verify(docs, _led(index, percent), classes, width, percent)
    release(some)
    links = first.union(second)
    index_ = index.join(_rooted(classes, links).select("c", "root"), "c")
    third = _verify(docs, _apart(index_, percent), classes, width, percent)
    release(index, classes)
    return rows, components(links.union(third))


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, a row for each row of documents.

    Null texts and texts without words have an empty set and no links. Fewer words than `width` make one shingle. Rows that share
    a doc_id are one node of the links, whatever their texts; rows without a doc_id are nodes of their own, and component_id is
    null where no doc_id can be reached. The result is exact but for collisions of 64-bit hashes of shingles.
    """
    rows, node = _linked(docs, width, percent)
    # ids with several texts link the groups of those texts
    several = stash(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("c").alias("k"), F.count("*").alias("all")).where("x <> y or k < all and k > 0").select("doc_id"), "several")
    named = rows.join(node, rows["c"] == node["node"], "left").select("doc_id", "n", F.coalesce("label", "c").alias("c"))
    if not several.isEmpty():
        own = rows.join(several, "doc_id", "left_semi").where("c is not null")
        lead = own.groupBy("doc_id").agg(F.min("c").alias("b"))
        node = components(node.select(F.col("node").alias("a"), F.col("label").alias("b")).union(own.select("doc_id", F.col("c").alias("a")).join(lead, "doc_id").select("a", "b")))
        named = rows.join(lead, "doc_id", "left").select("doc_id", "n", F.coalesce("c", "b").alias("c")).join(node, F.col("c") == F.col("node"), "left").select("doc_id", "n", F.coalesce("label", "c").alias("c"))
    named = stash(named, "named")
    least = named.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    return named.join(least, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def distinct(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked texts, that with the smallest doc_id (none counts as smaller, ties by hash of the text).

    Rows are told apart by doc_id and text: of rows alike in both one stays, and texts that only share a doc_id are not linked.
    Texts without words are linked with none and stay, one for each doc_id and text.
    """
    rows, node = _linked(docs, width, percent)
    rows = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), F.col("tk").alias("k2"), "c")
    named = rows.where("c is not null").join(node, F.col("c") == F.col("node"), "left").select("k1", "k2", F.coalesce("label", "c").alias("c"))
    named = stash(named.groupBy("k1", "k2", "c").count(), "named")
    first = named.groupBy("c").agg(F.min(F.struct("k1", "k2")).alias("f"))
    judged = stash(named.join(first, "c").selectExpr("k1", "k2", "count", "f.k1 = k1 and f.k2 = k2 as stays"), "judged")
    twice = judged.where("stays and count > 1").select("k1", "k2").union(rows.where("c is null").groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"))
    gone, twice = stash(judged.where("not stays").select("k1", "k2"), "gone"), stash(twice, "twice")
    sent = lambda keys: F.broadcast(keys) if keys.count() <= MOST_IDS else keys
    # a text's own key is computed in a struct beside the row, so that no column of the table can clash with it
    keyed = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), _text_key().alias("k2"))
    kept = keyed.join(sent(gone), ["k1", "k2"], "left_anti")
    if not twice.isEmpty():
        kept = kept.join(sent(twice), ["k1", "k2"], "left_anti").unionByName(kept.join(sent(twice), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    release(named, judged)
    return kept.select("row.*")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of `documents` by links of three-word shingles and a similarity of 0.9 or more; see `groups` for odd rows."""
    return groups(table(spark, sf_dir, "documents"))


#: The same groups by comparing the sets of all documents that share a shingle.
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {WIDTH - 2}))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s AS x JOIN s AS y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""
