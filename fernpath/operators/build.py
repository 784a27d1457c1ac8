"""Building a table of files and its index: deduplication, path order, numbering, writing, and keeping it up to date."""

from __future__ import annotations

import json
import os
import time
import warnings
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernpath import schema
from fernpath.functions import paths
from fernpath.operators import index as idx
from fernpath.operators.staging import release, remove, stash


class IndexError_(RuntimeError):
    """An index that is missing, locked, damaged or of another version."""


class Index(NamedTuple):
    """A written index: the files, (kind, gram, doc_id), (kind, gram, docs), one row that describes it all, and the number of files."""

    files: DataFrame
    postings: DataFrame
    grams: DataFrame
    about: DataFrame
    total: int


def default_place() -> str:
    """Where an index lies if nothing else is said: a folder in the user's cache."""
    cache = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return os.path.join(cache, "fernpath", "index")


def dedup(files: DataFrame, key: str = "full_path", order: str = "seq") -> DataFrame:
    """For each key the row that came first."""
    rest = [c for c in files.columns if c != key]
    first = files.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return first.select(key, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*files.columns)


def numbered(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """The files in path order with `doc_id` from 0: a range sort, and each partition's numbers start where the one before ends."""
    n = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = files.repartitionByRange(n, "full_path").sortWithinPartitions("full_path")
    ordered = stash(ordered.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("place")), "ordered")
    total, before = 0, []
    for r in ordered.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        before.append((r.part, total))
        total += r["count"]
    offsets = files.sparkSession.createDataFrame(before, "part int, before long")
    return ordered.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("place")).alias("doc_id"), *files.columns)


def pruned(files: DataFrame, prunes: list[str]) -> DataFrame:
    """Without paths that are or lie under one of `prunes`."""
    for p in prunes:
        files = files.where(~paths.under(F.col("full_path"), p))
    return files


def _checksum(files: DataFrame):
    """A number that any change of any row changes, whatever the order of the rows."""
    return F.coalesce(F.bit_xor(F.xxhash64("doc_id", *schema.COLUMNS)), F.lit(0)).alias("checksum")


def _versions(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema("version string").parquet(f"{where}/current")


def write(files: DataFrame, where: str | None = None, *, indexed_paths: list[str] = (), pruned_paths: list[str] = (), hostname: str = "", timestamp: int | None = None) -> None:
    """Write files, postings and a description to a new version under `where`, then make it the current one. Locked meanwhile.

    If it fails or is interrupted, what it wrote is removed and the version before stays the current one.
    """
    where, spark = where or default_place(), files.sparkSession
    with Lock(where, spark):
        try:
            last = int((_versions(spark, where).agg(F.max("version")).first()[0] or "v0")[1:])
        except AnalysisException:
            last = 0
        version = f"v{last + 1:012d}"  # counted, not dated: the writers' clocks may differ
        try:
            _write(files, where, version, indexed_paths, pruned_paths, hostname, timestamp)
        except BaseException:
            remove(spark, f"{where}/{version}")
            raise
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{where}/current")


def _write(files: DataFrame, where: str, version: str, indexed_paths, pruned_paths, hostname, timestamp) -> None:
    spark = files.sparkSession
    table = stash(idx.with_folds(numbered(files.select(*schema.COLUMNS))), "files")
    table.write.parquet(f"{where}/{version}/files")
    # doc_id in the range key, so that a gram that every path has is dealt to many tasks
    posted = idx.all_postings(table).repartitionByRange("kind", "gram", "doc_id").sortWithinPartitions("kind", "gram", "doc_id")
    posted.write.partitionBy("kind").parquet(f"{where}/{version}/postings")
    sizes = spark.read.parquet(f"{where}/{version}/postings").groupBy("kind", "gram").agg(F.count("*").alias("docs"))
    sizes.repartitionByRange("kind", "gram").sortWithinPartitions("kind", "gram").write.partitionBy("kind").parquet(f"{where}/{version}/grams")
    total = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.count("*").alias("n"), _checksum(table)).first()
    release(table)
    about = (schema.FORMAT_VERSION, list(indexed_paths), list(pruned_paths), int(time.time()) if timestamp is None else timestamp, hostname, total.s, total.n, total.checksum)
    fields = "format_version int, indexed_paths array<string>, pruned_paths array<string>, timestamp long, hostname string, total_bytes_indexed long, indexed_files long, checksum long"
    spark.createDataFrame([about], fields).coalesce(1).write.parquet(f"{where}/{version}/meta")


def read(spark: SparkSession, where: str | None = None, verify: bool = False) -> Index:
    """The current version of an index. Its number of rows is always checked (from the files' footers), every row if `verify`."""
    where = where or default_place()
    try:
        version = _versions(spark, where).agg(F.max("version")).first()[0]
    except AnalysisException as e:
        raise IndexError_(f"no index in {where}") from e
    try:
        tables = [spark.read.parquet(f"{where}/{version}/{k}") for k in ("files", "postings", "grams", "meta")]
        about = tables[3].first()
        found = Index(*tables, about.indexed_files)
        if about.format_version not in (1, schema.FORMAT_VERSION):
            raise IndexError_(f"{where} has another format")
        good = found.files.count() == about.indexed_files and (not verify or found.files.agg(_checksum(found.files)).first()[0] == about.checksum)
    except (PySparkException, Py4JJavaError, AttributeError, TypeError) as e:
        raise IndexError_(f"the index in {where} is damaged") from e
    if not good:
        raise IndexError_(f"the index in {where} is damaged: its rows are not those that were written")
    return found


def update(files: DataFrame, where: str | None = None, *, force: bool = False, quiet: bool = False, **about) -> str:
    """Bring an index up to a new state of the files; says whether it did so by `update` or by `rebuild`.

    Without an index, or one that cannot be read, everything is built anew, with a warning unless quiet; so it is if forced.
    """
    where = where or default_place()
    if not force:
        try:
            old = read(files.sparkSession, where).files.select(*schema.COLUMNS)
            changed = not changes(old, files).isEmpty() or not old.exceptAll(files.select(*schema.COLUMNS)).isEmpty()
            if changed:
                write(updated(old, files), where, **about)
            return "update"
        except IndexError_ as e:
            if "exists" in str(e):
                raise
            if not quiet:
                warnings.warn(f"{e}: building it anew", stacklevel=2)
    write(files, where, **about)
    return "rebuild"


def postings_bytes(spark: SparkSession, where: str) -> int:
    """Bytes of the postings of the current version as they are stored."""
    version = _versions(spark, where).agg(F.max("version")).first()[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/{version}/postings")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def report(where: str, posted: DataFrame, about: DataFrame, stored_bytes: int = 0) -> DataFrame:
    """One row `report`: the index's description and trigram statistics as JSON."""
    stats = idx.gram_stats(posted.where("kind = 'tri'"))
    columns = F.array(*(F.lit(c) for c in ["path", *schema.COLUMNS[1:]]))
    grams = F.struct("count", "min_docs", "max_docs", "avg_docs", "total_docs_indexed", F.lit(stored_bytes).cast("long").alias("bytes"))
    row = F.struct(
        F.lit(where).alias("database"), "indexed_files", "total_bytes_indexed", paths.rfc3339(F.col("timestamp")).alias("last_indexed"), F.lit(2).alias("schema_version"),
        "format_version", grams.alias("trigrams"), columns.alias("columns"),
    )
    return about.crossJoin(stats).select(F.to_json(row).alias("report"))  # one row each


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(full_path, change) with change one of added, removed, modified: what parts two states by size and mtime."""
    a, b = old.select("full_path", F.struct("size", "mtime").alias("was")), new.select("full_path", F.struct("size", "mtime").alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("modified")
    return a.join(b, "full_path", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("full_path", kind.alias("change"))


def updated(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state after an update: rows that agree in every column as they were, all others anew. Equal to a full rebuild."""
    same = old.join(new.select(*schema.COLUMNS), schema.COLUMNS, "left_semi")
    fresh = new.join(old.select(*schema.COLUMNS), schema.COLUMNS, "left_anti")
    return same.select(*schema.COLUMNS).unionByName(fresh.select(*schema.COLUMNS))


class Lock:
    """A lock file beside an index, made atomically by the file system that holds the index, and always removed."""

    def __init__(self, where: str, spark: SparkSession | None = None):
        self.path, self.spark = where.rstrip("/") + ".lock", spark if "://" in where else None

    def __enter__(self):
        if self.spark is not None:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(self.path)
            if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(where):
                raise IndexError_(f"{self.path} exists")
            return self
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        try:
            handle = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError as e:
            raise IndexError_(f"{self.path} exists") from e
        with os.fdopen(handle, "w") as file:
            json.dump({"pid": os.getpid()}, file)
        return self

    def __exit__(self, *_):
        if self.spark is not None:
            remove(self.spark, self.path)
        else:
            os.unlink(self.path)
