"""The catalogue of named queries and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernpath.functions import paths
from fernpath.operators import build, render
from fernpath.operators import index as idx
from fernpath.operators.search import counted, fetched, matches, search, sliced
from fernpath.operators.staging import shared_dir

NOW = 1706659200

_FILES = """SELECT doc_id, concat('/', source, '/', lang, '/', CASE WHEN doc_id % 7 = 0 THEN 'README' ELSE 'doc' END, '_',
  lpad(CAST(doc_id AS {STR}), 8, '0'),
  CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.rs' WHEN 3 THEN '.png' ELSE '' END) AS full_path,
  n_chars AS size, CAST(1704067200 + doc_id * 2592 AS BIGINT) AS mtime, CAST(33188 AS INT) AS mode,
  CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/x-rust' WHEN 3 THEN 'image/png'
    ELSE 'application/octet-stream' END AS mime_type FROM documents"""
_SPARK_FILES = _FILES.replace("FROM documents", "FROM {docs}")

QUERIES: dict = {}
ORACLES: dict = {}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of files made from documents' ids, sources and lengths; texts are not read."""
    return spark.sql(_SPARK_FILES.replace("{STR}", "STRING"), docs=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query(sql: str | None, name: str | None = None):
    """Register a query and its SQL, where FILES stands for the table of files and P for the five columns and the id."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            body = sql.replace("$P", "doc_id, full_path, size, mtime, mode, mime_type")
            ORACLES[name or f.__name__] = f"WITH files AS ({_FILES.replace('{STR}', 'VARCHAR')}) {body}"
        return f

    return register


def _search(name: str, where: str, patterns: list[str] | None = None, **how) -> None:
    query(f"SELECT $P FROM files WHERE {where}", name)(lambda spark, sf_dir: search(files(spark, sf_dir), patterns, **how))


_BUILT: dict[tuple[str, str], build.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> build.Index:
    """The written index of the files; built and opened once for each application and input, read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        where = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        build.write(files(spark, sf_dir).drop("doc_id"), where, indexed_paths=["/"], timestamp=NOW)
        _BUILT[key] = build.read(spark, where)
    return _BUILT[key]


_ORDINAL = "SELECT row_number() OVER (ORDER BY full_path) - 1 AS doc_id, full_path, size, mtime, mode, mime_type FROM files"


def _by_index(name: str, where: str, lookup) -> None:
    columns = ["doc_id", "full_path", "size", "mtime", "mode", "mime_type"]
    query(f"SELECT $P FROM ({_ORDINAL}) WHERE {where}", name)(lambda spark, sf_dir: lookup(index(spark, sf_dir)).select(*columns))


def _indexed(name: str, where: str, patterns: list[str], **how) -> None:
    _by_index(name, where, lambda found: search(found.files, patterns, index=found, **how))


_search("literal_search", "contains(full_path, 'README') AND size >= 1000", ["README"], size="1000+")
_search("literal_multi_or", "contains(full_path, 'README') OR contains(full_path, '/en/')", ["README", "/en/"])
_search("literal_glob_is_text", "contains(full_path, '*.rs')", ["*.rs"])
_search("ignore_case_ascii", "contains(lower(full_path), 'readme')", ["ReadMe"], ignore_case=True)
_search("basename_search", "contains(split_part(full_path, '/', -1), 'doc_00000')", ["doc_00000"], basename=True)
_search("basename_never_spans", "contains(split_part(full_path, '/', -1), 'en/')", ["en/"], basename=True)
_search("regex_search", r"regexp_matches(full_path, 'README_\d+[16]\.(rs|md)$')", [r"README_\d+[16]\.(rs|md)$"], regex=True)
_search("regex_ignore_case", r"regexp_matches(full_path, '(?i)readme_\d+\.MD$')", [r"readme_\d+\.MD$"], regex=True, ignore_case=True)
_search("regex_basename", r"regexp_matches(split_part(full_path, '/', -1), '^doc_0+[0-9]{2}\.')", [r"^doc_0+[0-9]{2}\."], regex=True, basename=True)
_search("regex_multi_or", r"regexp_matches(full_path, '/de/.*png') OR regexp_matches(full_path, '0{5}1')", ["/de/.*png", "0{5}1"], regex=True)
_search("regex_alternation", "regexp_matches(full_path, 'README|/fr/')", ["README|/fr/"], regex=True)
_search("size_ge", "size >= 10000", size="10KB+")
_search("size_le", "size <= 500", size="500-")
_search("size_eq", "size = 1234", size="1234B")
_search("modified_newer", f"mtime >= {NOW - 604800}", modified="1w-", now=NOW)
_search("modified_older", f"mtime <= {NOW - 20 * 86400}", modified="20d+", now=NOW)
_search("modified_eq", f"mtime = {NOW - 30 * 86400}", modified="30d", now=NOW)
_search("mime_exact", "mime_type = 'text/x-rust'", mime="text/x-rust")
_search("mime_glob", "starts_with(mime_type, 'text/')", mime="text/*")
_search("mime_glob_suffix", "starts_with(mime_type, '/json')", mime="*/json")
_search(
    "combined_filters", f"contains(full_path, 'README') AND size >= 1000 AND mtime >= {NOW - 28 * 86400} AND mime_type = 'text/markdown'",
    ["README"], size="1KB+", modified="4w-", mime="text/markdown", now=NOW,
)
_search("filter_only", f"size <= 2000 AND mtime <= {NOW - 86400}", size="2KB-", modified="1d+", now=NOW)
_search("empty_pattern", "true", ["", "README"])
_search("limit_path_order", "contains(full_path, 'doc') ORDER BY full_path LIMIT 25", ["doc"], limit=25)
_indexed("index_search_trigram", "contains(full_path, 'README')", ["README"])
_indexed("index_search_ignore_case", "contains(lower(full_path), 'readme_0000')", ["README_0000"], ignore_case=True)
_indexed("index_search_bigram", "contains(full_path, '.m')", [".m"])
_indexed("index_search_multi", "contains(full_path, '.md') OR contains(full_path, '.rs') OR contains(full_path, '77')", [".md", ".rs", "77"])
_indexed("index_search_short_pattern", "contains(full_path, '9') OR contains(full_path, 'README')", ["9", "README"])
_indexed("index_regex_prefilter", r"regexp_matches(full_path, '(README|doc)_\d+5\.txt')", [r"(README|doc)_\d+5\.txt"], regex=True)
_indexed("index_regex_limit", r"regexp_matches(full_path, 'README_\d+[05]\.') ORDER BY full_path LIMIT 15", [r"README_\d+[05]\."], regex=True, limit=15)
_by_index("index_extension", "full_path LIKE '%.rs'", lambda found: idx.with_extension(found.files, found.postings, "rs"))
_by_index("index_folder", "regexp_matches(full_path, '^/src1/en/[^/]*$')", lambda found: idx.in_folder(found.files, found.postings, "/src1/en"))
_by_index("index_folder_below", "starts_with(full_path, '/src1/')", lambda found: idx.in_folder(found.files, found.postings, "/src1/", below=True))
_by_index("point_fetch", "doc_id IN (3, 77, 150)", lambda found: fetched(found.files, [150, 3, 77]))
_by_index("written_files", "true", lambda found: found.files)
_search("regex_limit", r"regexp_matches(full_path, '\.md$') ORDER BY full_path LIMIT 12", [r"\.md$"], regex=True, limit=12)
_search("regex_posix_class", r"regexp_matches(full_path, '_[0-9]+7\.(md|rs)$')", [r"_[[:digit:]]+7\.(md|rs)$"], regex=True)


@query("SELECT doc_id, length(text) AS n FROM documents WHERE contains(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 'ss')")
def ignore_case_unicode(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.where(matches(docs, ["SS"], ignore_case=True, path="text")).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT page_id, url FROM pages WHERE contains(split_part(url, '/', -1), 'a')")
def basename_search_urls(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return pages.where(matches(pages, ["a"], basename=True, path="url"))


@query("SELECT page_id, split_part(url, '/', -1) AS name FROM pages")
def basename_project(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", paths.basename(F.col("url")).alias("name"))


@query(f"SELECT event_id, ts FROM events WHERE epoch(ts) >= {NOW - 5 * 86400}")
def modified_events(spark, sf_dir):
    from fernpath.functions import literals

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.where(literals.modified("5d-", F.unix_timestamp(events["ts"].cast("timestamp")), NOW)).select("event_id", "ts")


@query("SELECT full_path FROM files WHERE contains(full_path, 'README')")
def path_only(spark, sf_dir):
    return search(files(spark, sf_dir), ["README"]).select("full_path")


@query("SELECT count(*) AS count FROM files WHERE contains(full_path, 'README')")
def count_matches(spark, sf_dir):
    return counted(search(files(spark, sf_dir), ["README"]))


@query("SELECT count(*) AS count FROM (SELECT 1 FROM files WHERE contains(full_path, 'README') LIMIT 40)")
def count_with_limit(spark, sf_dir):
    return counted(search(files(spark, sf_dir), ["README"], limit=40))


def _folded(spark, sf_dir) -> DataFrame:
    return idx.with_folds(files(spark, sf_dir))


_GRAMS = "SELECT DISTINCT doc_id, substr(p, CAST(i AS INT), {n}) AS gram FROM (SELECT doc_id, lower(full_path) AS p, unnest(range(1, len(full_path) - {n} + 2)) AS i FROM files)"


@query(_GRAMS.format(n=3))
def trigram_explode(spark, sf_dir):
    return idx.postings(_folded(spark, sf_dir), 3)


@query(_GRAMS.format(n=2))
def bigram_explode(spark, sf_dir):
    return idx.postings(_folded(spark, sf_dir), 2)


def _listed(posted: DataFrame) -> DataFrame:
    return idx.lists(posted).select("gram", "block", F.size("doc_ids").cast("long").alias("docs"), F.concat_ws(",", F.transform("doc_ids", lambda x: x.cast("string"))).alias("doc_ids"))


_LISTS = "SELECT gram, doc_id // 1048576 AS block, count(*) AS docs, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM ({}) GROUP BY ALL"


@query(_LISTS.format(_GRAMS.format(n=3)))
def trigram_postings(spark, sf_dir):
    return _listed(idx.postings(_folded(spark, sf_dir), 3))


@query(_LISTS.format(_GRAMS.format(n=2)))
def bigram_postings(spark, sf_dir):
    return _listed(idx.postings(_folded(spark, sf_dir), 2))


_EXT = r"regexp_extract({}, '[^/]\.([^./]*)$', 1)"


@query(_LISTS.format(f"SELECT doc_id, {_EXT.format('full_path')} AS gram FROM files WHERE {_EXT.format('full_path')} <> ''"))
def ext_postings(spark, sf_dir):
    return _listed(idx.extension_postings(files(spark, sf_dir)))


@query(
    f"""SELECT count(*) AS count, CAST(min(n) AS BIGINT) AS min_docs, CAST(max(n) AS BIGINT) AS max_docs, CAST(sum(n) // count(*) AS BIGINT) AS avg_docs,
    CAST(sum(n) AS BIGINT) AS total_docs_indexed FROM (SELECT gram, count(*) AS n FROM ({_GRAMS.format(n=3)}) GROUP BY gram)"""
)
def trigram_stats(spark, sf_dir):
    return idx.gram_stats(idx.postings(_folded(spark, sf_dir), 3))


@query("SELECT gram, count(*) AS n FROM (SELECT DISTINCT p_partkey, substr(lower(p_name), CAST(i AS INT), 3) AS gram FROM (SELECT *, unnest(range(1, len(p_name) - 1)) AS i FROM part)) GROUP BY gram")
def trigram_counts_parts(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), paths.folded("p_name").alias("folded"))
    return idx.postings(part, 3).groupBy("gram").agg(F.count("*").alias("n"))


@query("SELECT text, min(doc_id) AS seq, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def dedup_by_path(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", F.col("doc_id").alias("seq"), "source")
    return build.dedup(docs, key="text")


@query("SELECT row_number() OVER (ORDER BY full_path) - 1 AS doc_id, full_path, size FROM files")
def doc_id_assign(spark, sf_dir):
    return build.numbered(files(spark, sf_dir).select("full_path", "size"))


@query("SELECT $P FROM files ORDER BY full_path")
def path_sort(spark, sf_dir):
    return files(spark, sf_dir).orderBy("full_path")


@query("SELECT $P FROM files WHERE NOT (full_path = '/src1' OR starts_with(full_path, '/src1/')) AND NOT starts_with(full_path, '/src2/en/')")
def prune_paths(spark, sf_dir):
    return build.pruned(files(spark, sf_dir), ["/src1/", "/src2/en", "/src3/e"])


_MIMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.MIME_BY_EXTENSION.items())


@query(f"SELECT doc_id, CASE lower({_EXT.format('full_path')}) {_MIMES} ELSE 'application/octet-stream' END AS mime FROM files")
def mime_from_extension(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", paths.mime_by_extension(F.col("full_path")).alias("mime"))


@query(f"SELECT page_id, {_EXT.format('url')} AS ext FROM pages")
def extension_extract(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", paths.extension(F.col("url")).alias("ext"))


@query(
    """SELECT doc_id, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0)
    WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0) ELSE concat(b, ' B') END AS human FROM (SELECT doc_id, size * (1 + doc_id * doc_id) AS b FROM files)"""
)
def human_size(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", paths.human_size(F.expr("size * (1 + doc_id * doc_id)")).alias("human"))


@query(
    f"""SELECT doc_id, CASE WHEN p < 0 THEN 'in the future' WHEN p < 60 THEN concat(p, ' seconds ago') WHEN p < 3600 THEN concat(p // 60, ' minutes ago')
    WHEN p < 86400 THEN concat(p // 3600, ' hours ago') WHEN p < 604800 THEN concat(p // 86400, ' days ago') WHEN p < 2592000 THEN concat(p // 604800, ' weeks ago')
    ELSE concat(p // 2592000, ' months ago') END AS age FROM (SELECT doc_id, {NOW} - (mtime + 7200 - doc_id * 100) AS p FROM files)"""
)
def relative_time(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", paths.relative_time(F.expr("mtime + 7200 - doc_id * 100"), NOW).alias("age"))


@query(
    """SELECT doc_id, CASE WHEN b < 1024 THEN 'grey' WHEN b < 1048576 THEN 'green' WHEN b < 104857600 THEN 'yellow' WHEN b < 1073741824 THEN 'red' ELSE 'bright red' END AS colour
    FROM (SELECT doc_id, size * (1 + doc_id * doc_id) AS b FROM files)"""
)
def size_class(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", paths.size_colour(F.expr("size * (1 + doc_id * doc_id)")).alias("colour"))


@query(
    f"""SELECT doc_id, CASE WHEN p < 0 THEN 'magenta' WHEN p < 3600 THEN 'bright green' WHEN p < 86400 THEN 'green' WHEN p < 604800 THEN 'yellow'
    WHEN p < 2592000 THEN 'white' ELSE 'grey' END AS colour FROM (SELECT doc_id, {NOW} - mtime AS p FROM files)"""
)
def time_class(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", paths.time_colour(F.col("mtime"), NOW).alias("colour"))


_ICONS = " ".join(f"WHEN {_EXT.format('full_path')} IN ({', '.join(repr(n) for n in names)}) THEN '{sign}'" for sign, names in paths.ICONS.items())


@query(f"SELECT doc_id, CASE {_ICONS} ELSE '{paths.OTHER_ICON}' END AS icon FROM files")
def icons(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", paths.icon(F.col("full_path")).alias("icon"))


@query(
    f"""SELECT full_path, CASE WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.1f KB', size / 1024.0) ELSE concat(size, ' B') END AS size_text,
    CASE WHEN p < 86400 THEN concat(p // 3600, ' hours ago') WHEN p < 604800 THEN concat(p // 86400, ' days ago') WHEN p < 2592000 THEN concat(p // 604800, ' weeks ago')
    ELSE concat(p // 2592000, ' months ago') END AS time_text, concat(CASE {_ICONS} ELSE '{paths.OTHER_ICON}' END, full_path) AS path_text
    FROM (SELECT *, {NOW} + 3600 - mtime AS p FROM files) WHERE contains(full_path, 'README') AND p BETWEEN 3600 AND 2591999"""
)
def table_cells(spark, sf_dir):
    now = NOW + 3600
    found = search(files(spark, sf_dir), ["README"]).where(F.col("mtime").between(now - 2591999, now - 3600))
    return render.cells(found, now, icons=True)


@query("SELECT doc_id, octet_length(encode(full_path)) AS width FROM files")
def visible_width(spark, sf_dir):
    painted = F.concat(F.lit("\x1b[1;97m"), "full_path", F.lit("\x1b[0m"))
    return files(spark, sf_dir).select("doc_id", paths.visible_width(painted).cast("long").alias("width"))


def _lines(spark, sf_dir, end: str) -> DataFrame:
    whole = "".join(render.terminated(search(files(spark, sf_dir), ["README"], limit=30), end))
    return spark.createDataFrame([(whole.replace("\0", "<NUL>"),)], "output string")


_FIRST = "(SELECT full_path FROM files WHERE contains(full_path, 'README') ORDER BY full_path LIMIT 30)"


@query(f"SELECT string_agg(full_path || '<NUL>', '' ORDER BY full_path) AS output FROM {_FIRST}")
def nul_output(spark, sf_dir):
    return _lines(spark, sf_dir, "\0")


@query(f"SELECT string_agg(full_path || chr(10), '' ORDER BY full_path) AS output FROM {_FIRST}")
def plain_output(spark, sf_dir):
    return _lines(spark, sf_dir, "\n")


@query(
    f"""SELECT concat('{{"database":"db","indexed_files":', (SELECT count(*) FROM files), ',"total_bytes_indexed":', (SELECT CAST(sum(size) AS BIGINT) FROM files),
    ',"last_indexed":"2024-01-31T00:00:00+00:00","schema_version":2,"format_version":2,"trigrams":{{"count":', count(*), ',"min_docs":', min(n), ',"max_docs":', max(n),
    ',"avg_docs":', CAST(sum(n) // count(*) AS BIGINT), ',"total_docs_indexed":', CAST(sum(n) AS BIGINT), ',"bytes":0}},"columns":["path","size","mtime","mode","mime_type"]}}') AS report
    FROM (SELECT gram, count(*) AS n FROM ({_GRAMS.format(n=3)}) GROUP BY gram)"""
)
def statistics_report(spark, sf_dir):
    found = index(spark, sf_dir)
    return build.report("db", found.postings, found.about)


@query("SELECT to_json({'path': full_path, 'size': size, 'mtime': mtime, 'mode': mode, 'mime_type': mime_type})::VARCHAR AS json FROM files WHERE contains(full_path, 'README')")
def json_render(spark, sf_dir):
    return render.as_json(search(files(spark, sf_dir), ["README"]))


@query(
    """SELECT doc_id, CASE WHEN len(full_path) <= 22 THEN full_path WHEN 18 - len(b) <= 0 THEN b
    ELSE concat('...', right(left(full_path, greatest(len(full_path) - len(b) - 1, 0)), 18 - len(b)), '/', b) END AS shown
    FROM (SELECT *, split_part(full_path, '/', -1) AS b FROM files)"""
)
def display_path(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", paths.display_path(F.col("full_path"), 22).alias("shown"))


@query("SELECT doc_id, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS shown FROM files")
def timestamp_rfc3339(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", paths.rfc3339(F.col("mtime")).alias("shown"))


def _two_states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    table = files(spark, sf_dir)
    return table.where("doc_id % 3 <> 0"), table.where("doc_id % 5 <> 0").withColumn("size", F.expr("if(doc_id % 2 = 0, size + 1, size)"))


@query("SELECT full_path, CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' ELSE 'modified' END AS change FROM files WHERE (doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 2 = 0) AND NOT (doc_id % 15 = 0)")
def incremental_diff(spark, sf_dir):
    return build.changes(*_two_states(spark, sf_dir))


@query("SELECT full_path, CASE WHEN doc_id % 2 = 0 THEN size + 1 ELSE size END AS size, mtime, mode, mime_type FROM files WHERE doc_id % 5 <> 0")
def incremental_update(spark, sf_dir):
    return build.updated(*_two_states(spark, sf_dir))


@query("SELECT $P FROM files WHERE contains(full_path, 'README') AND doc_id % 2 = 0")
def existing_filter(spark, sf_dir):
    table = files(spark, sf_dir)
    return search(table, ["README"], existing=table.where("doc_id % 2 = 0")).select("doc_id", "full_path", "size", "mtime", "mode", "mime_type")


@query("SELECT count(*) AS count, CAST(sum(size) AS BIGINT) AS total_bytes FROM files")
def dry_run_count(spark, sf_dir):
    return files(spark, sf_dir).agg(F.count("*").alias("count"), F.sum("size").alias("total_bytes"))


@query("SELECT $P FROM files WHERE doc_id BETWEEN 10 AND 19")
def slice_by_id(spark, sf_dir):
    return sliced(files(spark, sf_dir), 10, 10)
