"""Tables of files from file systems."""

from __future__ import annotations

import itertools
import os
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernpath import schema
from fernpath.functions import paths
from fernpath.operators.staging import stash
from fernpath.sources.ignores import Level

# What is walked and left out by default.
ROOTS = ["/home", "/etc", "/usr", "/opt"]
PRUNES = ["/proc", "/sys", "/dev", "/run", "/tmp", "/var/tmp", "/snap", "/lost+found"]
#: Names that a walk hands over to the executors at once.
CHUNK = 200_000


@dataclass
class Counts:
    """What a walk met: entries seen, files found, folders and entries left out, folders that could not be read, folders walked."""

    scanned: int = 0
    added: int = 0
    skipped: int = 0
    denied: int = 0
    folders: int = 0


def listing(spark: SparkSession, where: str) -> DataFrame:
    """Files below a folder of any file system Spark reads: full_path, size, mtime, mode (0: unknown) and type, by listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).select("path", "length", "modificationTime")
    path = F.regexp_replace("path", "^[a-z]+:(//)?", "")
    return files.select(path.alias("full_path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), F.lit(0).alias("mode"), paths.mime_by_extension(path).alias("mime_type"))


def _inside(path: str, roots: list[str]) -> bool:
    return any(path == r or path.startswith(r + "/") for r in roots)


def walk(roots: list[str], prunes: list[str] = (), quiet: bool = False, counts: Counts | None = None) -> Iterator[str]:
    """Real paths of files below the roots, hidden ones too. Links to files count as their targets, links to folders are left out.

    Folders are visited once even if roots overlap; what is pruned, broken, not UTF-8 or named by an ignore file is left out.
    """
    prunes = [os.path.realpath(p) for p in prunes if os.path.exists(p)]
    seen: set[tuple[int, int]] = set()
    counts = counts or Counts()
    for root in roots:
        if not os.path.exists(root):
            if not quiet:
                warnings.warn(f"skipped {root}: it does not exist", stacklevel=2)
            continue
        start = os.path.realpath(root)
        stack = [(start, Level.down_to(os.path.dirname(start)))]
        while stack:
            folder, above = stack.pop()
            if _inside(folder, prunes):
                counts.skipped += 1
                continue
            try:
                if os.path.isfile(folder):
                    counts.scanned, counts.added = counts.scanned + 1, counts.added + 1
                    yield folder
                    continue
                stat = os.stat(folder)
                if (stat.st_dev, stat.st_ino) in seen:
                    counts.skipped += 1
                    continue
                seen.add((stat.st_dev, stat.st_ino))
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                counts.denied += 1
                continue
            counts.folders += 1
            level = Level.of(folder, above)
            for e in entries:
                counts.scanned += 1
                try:
                    e.path.encode()
                except UnicodeEncodeError:
                    continue
                is_folder = e.is_dir(follow_symlinks=False)
                if level.ignores(e.path, is_folder):
                    counts.skipped += 1
                    continue
                if is_folder:
                    stack.append((e.path, level))
                    continue
                real = os.path.realpath(e.path) if e.is_symlink() else e.path
                if (os.path.isfile(real) if e.is_symlink() else e.is_file()) and not _inside(real, prunes):
                    counts.added += 1
                    yield real


def _head(path: str) -> bytes | None:
    """The first bytes of a file without extension; none if it cannot be read."""
    if "." in os.path.basename(path).lstrip("."):
        return None
    try:
        with open(path, "rb") as file:
            return file.read(512)
    except OSError:
        return None


def _details(magic: bool):
    def run(batches):
        for pdf in batches:
            rows = []
            for path in pdf["full_path"]:
                try:
                    stat = os.stat(path)
                    rows.append((path, stat.st_size, int(stat.st_mtime), stat.st_mode, _head(path) if magic else None))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["full_path", "size", "mtime", "mode", "head"])

    return run


def _listed(prunes: list[str], magic: bool):
    """From folders: the files right in them, with what there is to know of them, and the folders below (without a size)."""

    def run(batches):
        levels: dict[str, Level] = {}

        def level(folder: str) -> Level:
            if folder not in levels:
                parent = os.path.dirname(folder)
                levels[folder] = Level.of(folder, level(parent) if parent != folder else None)
            return levels[folder]

        for pdf in batches:
            found = []
            for folder in pdf["full_path"]:
                try:
                    entries = sorted(os.scandir(folder), key=lambda e: e.name)
                except OSError:
                    continue
                for e in entries:
                    try:
                        e.path.encode()
                        is_folder = e.is_dir(follow_symlinks=False)
                        real = os.path.realpath(e.path) if e.is_symlink() else e.path
                        if level(folder).ignores(e.path, is_folder) or _inside(real, prunes) or not (is_folder or os.path.isfile(real)):
                            continue
                        stat = os.stat(real)
                    except (OSError, UnicodeEncodeError):
                        continue
                    if is_folder:
                        found.append((real, None, None, None, None, f"{stat.st_dev}:{stat.st_ino}"))
                    else:
                        found.append((real, stat.st_size, int(stat.st_mtime), stat.st_mode, _head(real) if magic else None, None))
            yield pd.DataFrame(found, columns=["full_path", "size", "mtime", "mode", "head", "inode"]).astype({"size": "Int64", "mtime": "Int64", "mode": "Int32"})

    return run


def crawl_spread(spark: SparkSession, roots: list[str], prunes: list[str] = PRUNES, magic: bool = True) -> DataFrame:
    """The same files as crawl(), listed by the executors one depth of folders after the other.

    For file systems that are mounted alike on the driver and all executors. A folder that several paths lead to is listed once.
    """
    prunes = [os.path.realpath(p) for p in prunes if os.path.exists(p)]
    start = {os.path.realpath(r): os.stat(r) for r in roots if os.path.isdir(r)}
    files = [p for p in walk([r for r in roots if os.path.isfile(r)], prunes, quiet=True)]
    fields = "full_path string, size long, mtime long, mode int, head binary, inode string"
    now = spark.createDataFrame([(p, f"{s.st_dev}:{s.st_ino}") for p, s in start.items() if not _inside(p, prunes)], "full_path string, inode string").dropDuplicates(["inode"])
    seen = now = stash(now, "folders")
    found = spark.createDataFrame([(p,) for p in files], "full_path string").mapInPandas(_details(magic), "full_path string, size long, mtime long, mode int, head binary")
    while not now.isEmpty():
        level = stash(now.select("full_path").repartition(spark.sparkContext.defaultParallelism, "full_path").mapInPandas(_listed(prunes, magic), fields), "listed")
        found = found.unionByName(level.where("size is not null").drop("inode"))
        # the shortest name of a folder that several lead to
        below = level.where("size is null").groupBy("inode").agg(F.min("full_path").alias("full_path")).join(seen, "inode", "left_anti")
        now = stash(below.select("full_path", "inode"), "folders")
        seen = seen.unionByName(now)
    kind = paths.mime_type(F.col("full_path"), F.col("head"))
    return found.select("full_path", "size", "mtime", "mode", kind.alias("mime_type")).dropDuplicates(["full_path"])


def crawl(spark: SparkSession, roots: list[str] = ROOTS, prunes: list[str] = PRUNES, magic: bool = True, quiet: bool = False, counts: Counts | None = None) -> DataFrame:
    """Files of the driver's file system, with size, time, mode and type. Files whose details cannot be read are left out.

    Names go to the executors in chunks, so that the driver holds one chunk at a time.
    """
    names, found = walk(roots, prunes, quiet, counts), None
    while chunk := list(itertools.islice(names, CHUNK)) or ([] if found is not None else [None]):
        part = spark.createDataFrame([(p,) for p in chunk if p is not None], "full_path string").mapInPandas(_details(magic), "full_path string, size long, mtime long, mode int, head binary")
        part = part.select("full_path", "size", "mtime", "mode", paths.mime_type(F.col("full_path"), F.col("head")).alias("mime_type"))
        part = stash(part.select(*schema.COLUMNS), "crawled")
        found = part if found is None else found.unionByName(part)
        if chunk == [None]:
            break
    return found.dropDuplicates(["full_path"])
