"""Line-first cleaning with SQL expressions only.

Every line is judged by rules on punctuation, navigation and boilerplate; failing lines go, and a document that loses too
much of its text that way goes as a whole. Plain statistics of each document stand beside the verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernpath.llm.common import table

#: A document is rejected if its failing lines hold more than this share of its words, in hundredths.
MOST_LOST = 30
#: Lines with at least this many words must have a mark of punctuation.
LONG_LINE = 12
MIN_WORDS = 50
MOST_REPEATED = 50

# Words of site furniture; lines of up to BOILER_WORDS words that contain one are boilerplate.
BOILERPLATE = [
    "accept all cookies", "we use cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "enable javascript", "javascript is disabled", "click here", "read more", "sign up", "log in", "subscribe to our", "skip to content",
    "share this", "back to top", "lorem ipsum", "powered by", "follow us on",
]
BOILER_WORDS = 20
#: Up to so many different repeated windows are looked up one by one.
FEW = 8

_GAP = "[ \\\\t-\\\\r]"
_WORD = "[^ \\\\t-\\\\r]"


def _let(value: str, name: str, body: str) -> str:
    """SQL for `body` with `name` bound to `value`, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _words(text: str) -> str:
    return f"filter(split({text}, '{_GAP}+', -1), w0 -> w0 <> '')"


def _repeated_words(words: str) -> str:
    """Words that lie in a window of three words found twice or more; windows are compared by 64-bit hash.

    Most texts repeat none. Where few windows repeat, their places are looked up; else sorting brings equal ones together.
    """
    covered = "aggregate(transform(p, (x, k) -> if(k < size(p) - 1, least(3, get(p, k + 1) - x), 3)), 0L, (a, b) -> a + b)"
    few = "filter(transform(h, (x, i) -> if(array_contains(r, x), i, -1)), i -> i >= 0)"
    paired = "filter(s, (e, k) -> (k > 0 and get(s, k - 1).h = e.h) or (k < size(s) - 1 and get(s, k + 1).h = e.h))"
    many = _let("sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))", "s", f"sort_array(transform({paired}, e -> e.i))")
    again = _let("sort_array(h)", "o", "array_distinct(filter(o, (x, k) -> k > 0 and x = get(o, k - 1)))")
    places = _let(again, "r", f"case when size(r) <= {FEW} then {few} else {many} end")
    hashes = f"transform(sequence(0, size({words}) - 3), i -> xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2)))"
    return f"""case when size({words}) < 4 then 0L else {_let(hashes, "h", f"case when size(array_distinct(h)) = size(h) then 0L else {_let(places, 'p', covered)} end")} end"""


def _furniture(low: str) -> str:
    return "(" + " or ".join(f"contains({low}, '{x}')" for x in BOILERPLATE) + ")"


def _line_fails(line: str) -> str:
    """Words of the line if a rule fails it, else 0. Cheap tests come first; words are counted only where one of them hits.

    `site` says whether the whole text has any words of site furniture.
    """
    marked = f"""size(split({line}, '[|»›]', -1)) >= 3
      or 5 * (size(split({line}, '[#*$%&|<>]', -1)) - 1) > n
      or (n >= 5 and 5 * (size(split({line}, '!!', -1)) - 1) > n)
      or (n >= {LONG_LINE} and not {line} rlike '[.,;:!?]')
      or (n <= {BOILER_WORDS} and boiler)"""
    judged = _let(f"size({_words(line)})", "n", f"case when {marked} then n else 0 end")
    tested = f"case when boiler or {line} rlike '[#*$%&|<>»›]|!!' or not {line} rlike '[.,;:!?]' then {judged} else 0 end"
    return _let(f"case when site then {_let(f'lower({line})', 'low', _furniture('low'))} else false end", "boiler", tested)


def _stats() -> str:
    """One struct a document, from the columns word (array of words) and line (array of lines)."""
    return f"""named_struct(
      'n_words', cast(size(w) as bigint),
      'word_chars', cast(length(array_join(w, '')) as bigint),
      'n_symbols', cast(size(split(t, '[#*$%&|<>]', -1)) - 1 as bigint),
      'n_dup_lines', {_let(f"filter(l, x -> x rlike '{_WORD}')", 'f', 'cast(size(f) - size(array_distinct(f)) as bigint)')},
      'n_repeat_words', {_repeated_words('w')},
      'lost', {_let(_let("lower(t)", "low", _furniture("low")), "site", f"transform(l, x -> {_line_fails('x')})")})"""


def judged(docs: DataFrame, *extra: str) -> DataFrame:
    """Rows of struct `q`: the counts, base_failed, lost_words, the words lost by line and `kept`; before it what SQL `extra` says.

    A null or empty text has no words and fails. Lines are parted by line feeds only; windows are compared by 64-bit hash. Rows
    are judged one by one, so repeated rows and ids each have their verdict.
    """
    stats = _let("split(t, '\\n', -1)", "l", _let(_words("t"), "w", _stats()))
    failed = f"(s.n_words < {MIN_WORDS} or 100 * s.n_repeat_words > {MOST_REPEATED} * s.n_words)"
    lost = f"""named_struct('n_words', s.n_words, 'word_chars', s.word_chars, 'n_symbols', s.n_symbols, 'n_dup_lines', s.n_dup_lines,
      'n_repeat_words', s.n_repeat_words, 'base_failed', {failed}, 'lost_words', c, 'lost', s.lost,
      'kept', not {failed} and 100 * c <= {MOST_LOST} * s.n_words)"""
    verdict = _let("aggregate(s.lost, 0L, (a, b) -> a + b)", "c", lost)
    # a generated row is computed once, however often its fields are read
    return docs.selectExpr(*extra, f"explode(array({_let("coalesce(text, '')", 't', _let(stats, 's', verdict))})) as q")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, lost_words and kept, a row for each row of documents; see `judged` for odd texts."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept")
    return judged(docs, "doc_id").selectExpr("doc_id", *(f"q.{c} as {c}" for c in names))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines; other columns as they were, n_chars that of the new text.

    Null, empty and short texts fail. Repeated rows stay as often as they pass.
    """
    row = "struct(" + ", ".join(f"`{c}`" for c in docs.columns) + ") as row"
    rest = "if(q.lost_words = 0, row.text, array_join(filter(split(row.text, '\\n', -1), (x, i) -> get(q.lost, i) = 0), '\n'))"
    passed = judged(docs, row).where("q.kept").selectExpr("row", f"explode(array({rest})) as rest")
    new = {"text": F.col("rest"), "n_chars": F.length("rest").cast("long")}
    return passed.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; see `judged` for odd rows."""
    return verdicts(table(spark, sf_dir, "documents"))


_SQL_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, {_SQL_WORDS.format("t")} AS w, string_split(t, chr(10)) AS l FROM d),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM a WHERE len(w) >= 3),
key AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM win),
rep AS (SELECT doc_id, i FROM key QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
line AS (SELECT doc_id, x, len({_SQL_WORDS.format("x")}) AS n FROM (SELECT doc_id, unnest(l) AS x FROM a)),
bad AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS lost FROM line WHERE
  len(x) - len(regexp_replace(x, '[|»›]', '', 'g')) >= 2
  OR 5 * (len(x) - len(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) > n
  OR (n >= 5 AND 5 * len(regexp_extract_all(x, '!!')) > n)
  OR (n >= {LONG_LINE} AND NOT regexp_matches(x, '[.,;:!?]'))
  OR (n <= {BOILER_WORDS} AND regexp_matches(lower(x), '{"|".join(BOILERPLATE)}')) GROUP BY doc_id),
s AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(bad.lost, 0) AS lost_words
  FROM a LEFT JOIN cov USING (doc_id) LEFT JOIN bad USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, lost_words,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_words <= {MOST_LOST} * n_words AS kept
FROM s
"""
