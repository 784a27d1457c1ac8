"""Nearest neighbours by a block matrix join: int8 products bound each distance, the few pairs that may count are computed in full.

Rows travel as int8 values with a scale and an error. A tile of queries and candidates gives each query those candidates whose lower
bound does not lie above its k-th smallest upper bound; the same test over all of a query's tiles leaves few pairs, and only for
those the vectors themselves are joined back, computed in double precision and merged by a heap.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernpath.llm.common import out, stash, table

K = 10
QUERY_STEP = 100
#: Rows of a tile: so many queries by so many candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Dimensions whose int8 products add up exactly in float32.
EXACT_DIMS = 1024
_TINY = np.finfo(np.float64).tiny


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (as doubles) of the vectors that take part: not null, not all zero, every component finite."""
    good = "embedding is not null and vec_id is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    return vectors.selectExpr("cast(vec_id as long) as vec_id", "cast(embedding as array<double>) as embedding").where(good)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as int8 values times a scale, and how far each row lies from that, in units of the scale."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, _TINY)
    exact = x / scale[:, None]
    q = np.rint(exact)
    # 1e-9: what the division and the sum may be off by
    return q.astype(np.int8), scale, np.sqrt(((exact - q) ** 2).sum(axis=1)) + 1e-9 * math.sqrt(x.shape[1])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, components added in order.

    Where squares overflow or vanish, differences are taken in units of the largest one.
    """
    total = np.zeros(len(x))
    with np.errstate(over="ignore", under="ignore"):
        for d in range(x.shape[1]):
            diff = x[:, d] - y[:, d]
            total += diff * diff
        found = np.sqrt(total)
        odd = np.flatnonzero(~np.isfinite(total) | (total < 1e-290))
        if len(odd):
            half = x[odd] / 2 - y[odd] / 2  # differences of finite numbers may overflow themselves
            unit = np.abs(half).max(axis=1)
            safe = np.where(unit > 0, unit, 1.0)
            found[odd] = np.where(unit > 0, np.sqrt(((half / safe[:, None]) ** 2).sum(axis=1)) * safe * 2, 0.0)
    return found


def bounds(q: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of all pairs of rows (int8 values, scale, error).

    With row errors e and f, a distance of quantised rows is off by e + f at most. All is computed in units of the largest scale.
    """
    (qi, qs, qe), (ci, cs, ce) = q, c
    unit = max(qs.max(), cs.max())
    qs, cs = qs / unit, cs / unit
    qf, cf = qi.astype(np.float32), ci.astype(np.float32)
    product = sum((qf[:, d : d + EXACT_DIMS] @ cf[:, d : d + EXACT_DIMS].T).astype(np.float64) for d in range(0, qf.shape[1], EXACT_DIMS))
    qn, cn = ((x.astype(np.float64) ** 2).sum(axis=1) * s**2 for x, s in ((qi, qs), (ci, cs)))
    about = np.sqrt(np.maximum(qn[:, None] + cn[None, :] - 2 * (qs[:, None] * cs[None, :]) * product, 0))
    slack = (qs * qe)[:, None] + (cs * ce)[None, :] + 1e-7 * (np.sqrt(qn)[:, None] + np.sqrt(cn)[None, :])
    with np.errstate(over="ignore"):
        return np.maximum(about - slack, 0) * unit, (about + slack) * unit


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each query's candidates of a tile that may be among its K nearest, with their bounds."""
    ids, keys, asked, found = pdf["vec_id"].to_numpy(np.int64), pdf["key"].to_numpy(np.int64), pdf["asked"].to_numpy(bool), []
    if asked.any() and not asked.all():
        rows = np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(len(pdf), -1), pdf["scale"].to_numpy(), pdf["error"].to_numpy()
        c, c_id, c_key = tuple(x[~asked] for x in rows), ids[~asked], keys[~asked]
        for s in range(0, int(asked.sum()), 256):  # a strip of the tile at a time
            q, q_id = (tuple(x[asked][s : s + 256] for x in rows)), ids[asked][s : s + 256]
            low, high = bounds(q, c)
            own = q_id[:, None] == c_id[None, :]
            high = np.where(own, np.inf, high)
            most = np.partition(high, K - 1, axis=1)[:, K - 1 : K] if len(c_id) > K else np.full((len(q_id), 1), np.inf)
            r, k = np.nonzero((low <= most) & ~own)
            found.append(pd.DataFrame({"query_id": q_id[r], "vec_id": c_id[k], "key": c_key[k], "low": low[r, k], "high": high[r, k]}))
    none = {"query_id": np.int64, "vec_id": np.int64, "key": np.int64, "low": np.float64, "high": np.float64}
    return pd.concat(found) if found else pd.DataFrame({name: np.zeros(0, kind) for name, kind in none.items()})


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    best = heapq.nsmallest(K, zip(pdf["score"].tolist(), pdf["vec_id"].tolist(), pdf["times"].tolist()))
    best = [x[:2] for x in best for _ in range(min(x[2], K))][:K]  # a row found several times counts as often
    return pd.DataFrame(
        {"query_id": int(pdf["query_id"].iloc[0]), "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": [v for _, v in best], "score": [s for s, _ in best]}
    )


def _small(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, asked, dims, q, scale, error) of rows (vec_id, key, asked, embedding)."""
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.int64()), ("asked", pa.bool_()), ("dims", pa.int32()), ("q", pa.binary()), ("scale", pa.float64()), ("error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("embedding").to_numpy(zero_copy_only=False)
            size = np.fromiter(map(len, rows), np.int64, len(rows))
            for dims in np.unique(size).tolist():
                at = np.flatnonzero(size == dims)
                q, scale, error = quantised(np.stack(rows[at]))
                yield out(schema, *(batch.column(k).take(pa.array(at)) for k in ("vec_id", "key", "asked")), np.full(len(at), dims, np.int32), [x.tobytes() for x in q], scale, error)

    return vectors.select("vec_id", "key", "asked", "embedding").mapInArrow(run, "vec_id long, key long, asked boolean, dims int, q binary, scale double, error double")


def nearest(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id and score of each query's K nearest of `vectors`, ties to the smaller vec_id.

    A query's own vec_id is no candidate. Only vectors of the query's own number of components are compared with it. Candidates
    whose vec_id repeats count once for each row; queries count once for each vec_id, with the smallest of its vectors. Exact: the
    bounds drop no neighbour.
    """
    key = F.xxhash64("embedding").alias("key")  # tells vectors of one vec_id apart
    vectors = stash(vectors.groupBy("vec_id", "embedding").agg(F.count("*").alias("times")).select("*", key), "vectors")
    queries = stash(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("*", key), "queries")
    n_q, n_c = math.ceil(queries.count() / QUERY_BLOCK) or 1, math.ceil(vectors.count() / CANDIDATE_BLOCK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    c = _small(vectors.drop("times").withColumn("asked", F.lit(False))).withColumn("cb", some(n_c)).withColumn("qb", every(n_q))
    q = _small(queries.withColumn("asked", F.lit(True))).withColumn("cb", every(n_c)).withColumn("qb", some(n_q))
    bound = "query_id long, vec_id long, key long, low double, high double"
    pairs = stash(q.unionByName(c).groupBy("qb", "cb", "dims").applyInPandas(_tile, bound), "pairs")
    # the K-th smallest upper bound over all tiles; a query has few pairs left, some more than K from each tile
    most = pairs.groupBy("query_id").agg(F.element_at(F.slice(F.sort_array(F.collect_list("high")), 1, K), -1).alias("most"), F.count("*").alias("n"))
    left = pairs.join(most, "query_id").where(f"n <= {K} or low <= most").select("query_id", "vec_id", "key")
    x = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))
    y = vectors.select("vec_id", "key", "times", F.col("embedding").alias("y"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("times", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("x", "y"))
            size, score = np.fromiter(map(len, x), np.int64, len(x)), np.zeros(len(x))
            for dims in np.unique(size).tolist():
                at = np.flatnonzero(size == dims)
                score[at] = distances(np.stack(x[at]), np.stack(y[at]))
            yield out(schema, *(batch.column(k) for k in ("query_id", "vec_id", "times")), score)

    scored = left.join(y, ["vec_id", "key"]).join(x, "query_id").select("query_id", "vec_id", "times", "x", "y").mapInArrow(run, "query_id long, vec_id long, times long, score double")
    return scored.groupBy("query_id").applyInPandas(_merge, "query_id long, rank int, vec_id long, score double")


def op10_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to each whose vec_id is divisible by 100; see `nearest` and `usable` for odd rows."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


ORACLE = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b)) AS score FROM v AS q JOIN v ON len(q.e) = len(v.e) AND q.vec_id <> v.vec_id
  WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= {K}
"""
