"""What the operators share: reading tables, written intermediate tables, byte batches.

Rows are handed on as they are: none of these functions drops or joins rows, so nulls, ties and repeated rows stay the operators' affair.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernpath.operators.staging import release, shared_dir, stash, tidy  # noqa: F401

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = " \t\n\x0b\x0c\r"
#: Texts are handled in Python in blocks of about this many bytes.
BLOCK_BYTES = 1 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def most_frequent(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The rows (.., n) with the highest n, `most` at most and never some of those that share an n, and the least n among them.

    Counts are tallied by their logarithms first, so that only the rows wanted leave the executors. Where the least tally alone
    is too large nothing is returned; the least n is then one more than any.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    tally = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("largest")).collect()  # 16 rows for each doubling
    total, least = 0, 1 + max((r.largest for r in tally), default=0)
    for r in sorted(tally, reverse=True):
        if (total := total + r.rows) > most:
            break
        least = r.least
    return counts.where(F.col("n") >= least), least


def id_text(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def raw(df: DataFrame, *extra) -> DataFrame:
    """doc_id, the text's UTF-8 bytes (null: empty) and extra columns; other columns of the table are left out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), *extra)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of a binary column, a row at least.

    Unless `keep`, what tasks of another kind have left in this worker (see chunks.lasting) is let go first: memory is for this task.
    """
    if not keep:
        sys.__dict__.pop("_fernpath_lasting", None)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if total and total + size > most:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += size
        yield batch.slice(start)


def out(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
