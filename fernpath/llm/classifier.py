"""A quality classifier by compression: the text that a dictionary of good texts shortens more than one of bad texts is good.

Two zstandard dictionaries are built from labelled texts. A text's score comes from the difference of its two compressed sizes,
divided by their sum, by way of a logistic curve fitted on labelled texts that went into neither dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernpath.llm.common import blocks, id_text, out, raw, table

#: Bound of the training sample: labelled texts of each class, whole; half go to the dictionary, half to the curve.
SAMPLE_TEXTS = 2_000
DICT_BYTES, LEVEL = 32_000, 1
#: Texts are compressed in blocks of this many bytes, each from the dictionary alone, so that a long text's own past does not stand in for it.
TEXT_BLOCK = 512
FOLDS, HELD_OUT = 3, 1


def held_out(folds: int = FOLDS, fold: int = HELD_OUT):
    return F.crc32(id_text().cast("binary")) % folds == fold


def sample(docs: DataFrame, labels: DataFrame) -> dict[int, list[bytes]]:
    """For each class up to SAMPLE_TEXTS whole training texts, those with the smallest hashes of their ids.

    Ids with several texts count with the smallest of them, ids with several labels in each class that they have.
    """
    found = {}
    for quality in (0, 1):
        ids = (
            labels.where(F.col("doc_id").isNotNull() & (F.col("quality") == quality) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"))
            .distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_TEXTS)
        )
        rows = raw(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # SAMPLE_TEXTS ids at most
        found[quality] = [bytes(t) for _, t in sorted((r.doc_id, r.text) for r in rows.collect())]
    return found


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary where there is enough text for one, else the texts themselves as raw content.

    Texts are given to the training in blocks of TEXT_BLOCK bytes, as they are compressed later.
    """
    total = sum(map(len, texts))
    if total > 20 * 1024 and len(texts) >= 16:
        samples = [t[k : k + TEXT_BLOCK] for t in texts for k in range(0, len(t), TEXT_BLOCK)]
        try:
            return zstandard.train_dictionary(min(size, max(2048, total // 4)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(texts)[:size] or b"\n" * 64


class Model:
    """Compressors for both dictionaries, and the curve from size difference to score."""

    def __init__(self, bad: bytes, good: bytes, slope: float = 1.0, offset: float = 0.0):
        self.slope, self.offset = slope, offset
        self.compress = []
        for data in (bad, good):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress)

    def difference(self, text: bytes) -> float:
        """From -1 to 1: how much shorter the text is with the good dictionary than with the bad one. Empty: 0."""
        if not text:
            return 0.0
        bad, good = (sum(len(c(text[k : k + TEXT_BLOCK])) for k in range(0, len(text), TEXT_BLOCK)) for c in self.compress)
        return (bad - good) / (bad + good)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(text) + self.offset, -30, 30))))


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y by x, both classes weighted alike, by Newton's method."""
    if not len(x) or y.min() == y.max():
        return 0.0, 0.0 if not len(x) else (2.0 if y[0] else -2.0)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    unit = x.std() or 1.0
    a, beta = np.stack([x / unit, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta[0] / unit, beta[1]


def fit(texts: dict[int, list[bytes]]) -> tuple[bytes, bytes, float, float]:
    bad, good = (dictionary(texts[q][::2]) for q in (0, 1))
    model = Model(bad, good)
    pairs = [(model.difference(t), q) for q in (0, 1) for t in texts[q][1::2]]
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
    return bad, good, *curve(x, y)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of documents; a null text counts as empty.

    Without labelled texts of both classes every score is on the side of the class there is, or 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels)))  # two dictionaries of DICT_BYTES at most
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for part in blocks(batches):
            found = [model.score(t) for t in part.column("text").to_pylist()]
            yield out(schema, part.column("doc_id"), part.column("held_out"), found, [int(s >= 0.5) for s in found])

    return raw(docs, held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; see `scores` for odd rows."""
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
