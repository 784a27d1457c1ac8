"""Personal data: four kinds by pattern, and more by contexts that those induce. SQL expressions only.

Identifier-like strings are instances; the two words before one, the word before it and the word behind it are patterns. Instances
of known kind vouch for the patterns they meet, patterns for the other instances that they meet, and so on for ROUNDS rounds over the
whole corpus. What meets a pattern that ends with high confidence is found too, whatever its own form. Secrets have no base pattern;
their seeds are the forms of well-known credentials and long hexadecimal strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernpath.llm.common import stash, table

ROUNDS = 3
#: A pattern must reach this score, over at least this many different instances of a kind, to discover others.
CONFIDENT, SUPPORT = 0.6, 4
#: The same for patterns of one word, which say less.
CONFIDENT_ONE, SUPPORT_ONE = 0.8, 8
KINDS = ["email", "ip", "card", "phone", "secret"]

# The patterns of the base kinds. Looking behind keeps a start from being tried inside a run that has failed
# already; possessive groups keep long runs from deep recursion; neither changes what is found.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Instances: strings of identifier characters with a digit, 6 or more long.
INSTANCE = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]*+[0-9])[A-Za-z0-9._%+@-]{6,}+"
# Seeds of the kind `secret`: prefixes of well-known credentials, and hexadecimal strings with digits and letters.
SECRETS = [
    "(AKIA|ASIA|AGPA|AROA)[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{20,}", "github_pat_[A-Za-z0-9_]{22,}", "glpat-[A-Za-z0-9_-]{20,}", "sk-[A-Za-z0-9_-]{20,}", "(sk|pk|rk)_(live|test)_[A-Za-z0-9]{16,}",
    "xox[abeoprs]-[A-Za-z0-9-]{10,}", "AIza[A-Za-z0-9_-]{35}", "ya29[.][A-Za-z0-9_-]{20,}", "SG[.][A-Za-z0-9_-]{16,}[.][A-Za-z0-9_-]{16,}", "npm_[A-Za-z0-9]{36}", "hf_[A-Za-z0-9]{30,}",
    "eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", "(?=.*[a-f])(?=.*[0-9])[0-9a-f]{16,}", "(?=.*[A-F])(?=.*[0-9])[0-9A-F]{16,}",
]
SECRET = f"^(?:{'|'.join(SECRETS)})[.]?$"

_ID = "coalesce(cast(doc_id as long), -9223372036854775808)"
_SPANS = "array<struct<s:int,k:int,e:int>>"
_DIGITS = "regexp_replace(x, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length(g)), 0, (a, i) -> a + let_d(i))""".replace(
    "let_d(i)", "transform(array(cast(substring(g, length(g) + 1 - i, 1) as int)), d -> if(i % 2 = 1, d, if(d > 4, 2 * d - 9, 2 * d)))[0]"
)
_VALID = {
    "email": "true",
    "ip": "forall(split(x, '[.]'), y -> length(trim(LEADING '0' FROM y)) <= 3 and cast(concat('0', right(y, 3)) as int) <= 255)",
    "card": f"transform(array({_DIGITS}), g -> if(length(g) between 12 and 19, {_LUHN} % 10 = 0, false))[0]",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
_GATE = {"email": "contains(t, '@')", "ip": "contains(t, '.') and t rlike '[0-9][.][0-9]'", "card": "t rlike '[0-9][ -]?[0-9]'", "phone": "contains(t, '+')"}
_RULE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _found(gate: str, pattern: str, empty: str, keep: str, row: str) -> str:
    """SQL for the matches x at code points b to b + length(x) with text seg[i] before them, as an array of `row` where `keep`.

    What lies between matches gives their places.
    """
    p = _sql(pattern)
    step = f"""transform(array(named_struct('x', m[i], 'b', acc.p + length(seg[i]))), q ->
      transform(array(q.x), x -> named_struct('p', q.b + length(x), 'o', if({keep}, concat(acc.o, array({row})), acc.o)))[0])[0]"""
    walk = f"aggregate(sequence(0, size(m) - 1), named_struct('p', 0, 'o', {empty}), (acc, i) -> {step}, acc -> acc.o)"
    return f"""case when {gate} then transform(array(split(t, {p}, -1)), seg -> transform(array(regexp_extract_all(t, {p}, 0)), m ->
      if(size(m) = 0, {empty}, {walk}))[0])[0] else {empty} end"""


def _base() -> str:
    empty = f"cast(array() as {_SPANS})"
    parts = [_found(_GATE[k], _RULE[k], empty, _VALID[k], f"named_struct('s', q.b, 'k', {n}, 'e', q.b + length(x))") for n, k in enumerate(KINDS[:4])]
    return f"sort_array(concat({', '.join(parts)}))"


def _candidates() -> str:
    """Instances with their places and patterns; digits in patterns count as alike. A pattern's first letter says which words it has.

    Words before an instance are read backwards, so that each is looked at once however long it is.
    """
    left = r"regexp_extract(reverse(seg[i]), r'^(\s*+\S++(?:\s++\S++)?+)', 1)"
    one = r"regexp_extract(reverse(seg[i]), r'^(\s*+\S++)', 1)"
    right = r"regexp_extract(coalesce(get(seg, i + 1), ''), r'^(\s*+\S++)', 1)"
    patterns = f"array(concat('b', reverse({left})), concat('a', reverse({one})), concat('c', {right}))"
    patterns = f"transform(filter({patterns}, z -> length(z) > 1), z -> regexp_replace(lower(z), '[0-9]', '0'))"
    empty = "cast(array() as array<struct<s:int,e:int,p:array<string>,x:string>>)"
    return _found("t rlike '[0-9]'", INSTANCE, empty, "true", f"named_struct('s', q.b, 'e', q.b + length(x), 'p', {patterns}, 'x', x)")


def _scanned(docs: DataFrame) -> DataFrame:
    """d, tk (id and text's hash), base spans and candidates with the kind of the base span they touch, if any."""
    text = "coalesce(text, '')"
    key = docs.selectExpr("doc_id", f"{_ID} as d", f"xxhash64({text}) as tk", f"{text} as t")
    both = key.selectExpr("doc_id", "d", "tk", f"{_base()} as base", f"{_candidates()} as c")
    touch = "get(filter(base, b -> b.s < y.e and y.s < b.e), 0).k"
    seed = f"transform(c, y -> named_struct('s', y.s, 'e', y.e, 'p', y.p, 'x', y.x, 'base', {touch}, 'k', coalesce({touch}, if(y.x rlike {_sql(SECRET)}, 4, null))))"
    return both.selectExpr("doc_id", "d", "tk", "base", f"{seed} as c")


def _score(edges: DataFrame) -> DataFrame:
    """(p, k): patterns of high confidence and the kind they find. edges: distinct (p, x, k), k the kind of seeds, else null."""
    size = edges.groupBy("p").agg(F.count("*").alias("n"))
    belief = edges.where("k is not null").groupBy("x", "k").agg(F.lit(1.0).alias("r"))
    edge = edges.select("p", "x").distinct()
    for turn in range(ROUNDS):
        # a pattern's score: the share of its instances that are believed, less for patterns with few of them
        weight = edge.join(belief, "x").groupBy("p", "k").agg(F.sum("r").alias("sum"), F.sum(F.when(F.col("r") >= CONFIDENT, 1).otherwise(0)).alias("support"))
        pattern = weight.join(size, "p").select("p", "k", "support", (F.col("sum") / F.col("n") * (1 - F.pow(F.lit(2.0), -F.col("sum")))).alias("score"))
        pattern = stash(pattern, f"patterns{turn}")
        if turn < ROUNDS - 1:
            # an instance is believed unless all patterns it follows are wrong; seeds stay certain
            doubt = edge.join(pattern.where("support >= 2"), "p").groupBy("x", "k").agg(F.sum(F.log1p(-F.least("score", F.lit(0.999)))).alias("d"))
            new = doubt.select("x", "k", (1 - F.exp("d")).alias("r"))
            belief = belief.where("r = 1").unionByName(new).groupBy("x", "k").agg(F.max("r").alias("r"))
    best = Window.partitionBy("p").orderBy(F.desc("score"), "k")
    two = F.col("p").startswith("b")
    sure = pattern.where(two & (F.col("score") >= CONFIDENT) & (F.col("support") >= SUPPORT) | ~two & (F.col("score") >= CONFIDENT_ONE) & (F.col("support") >= SUPPORT_ONE))
    return sure.withColumn("first", F.row_number().over(best)).where("first = 1").select("p", "k")


def found(docs: DataFrame) -> DataFrame:
    """doc_id, d, tk, base and spans (arrays of s, k, e sorted by start and kind), a row for each row of documents.

    A null text counts as empty. Patterns are learned from the documents given, all of them; repeated strings count once, so that
    repeated rows change no score. Where patterns of several kinds discover a string, it is a span of each.
    """
    seen = stash(_scanned(docs), "seen")
    each = seen.select("d", "tk", F.explode("c").alias("c")).select("d", "tk", "c.*")
    edges = stash(each.select("x", "k", F.explode("p").alias("p")).groupBy("p", "x").agg(F.min("k").alias("k")), "edges")
    sure = stash(_score(edges), "sure")
    open_ = each.where("k is null").select("d", "tk", "s", "e", F.explode("p").alias("p"))
    more = open_.join(sure.withColumnRenamed("k", "kind"), "p").groupBy("d", "tk")
    more = more.agg(F.collect_set(F.expr("named_struct('s', s, 'k', kind, 'e', e)")).alias("more"))
    seeds = "transform(filter(c, y -> y.base is null and y.k is not null), y -> named_struct('s', y.s, 'k', y.k, 'e', y.e))"
    spans = f"sort_array(concat(base, {seeds}, coalesce(more, cast(array() as {_SPANS}))))"
    return seen.join(more, ["d", "tk"], "left").selectExpr("doc_id", "d", "tk", "base", f"{spans} as spans")


def _text(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, y -> concat(array({names})[y.k], ':', y.s, ':', y.e)), ',')"


def listed(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, all spans, n_secret and n_spans, a row for each row of documents."""
    counts = [f"cast(size(filter(base, y -> y.k = {n})) as bigint) as n_{k}" for n, k in enumerate(KINDS[:4])]
    after = ["cast(size(filter(spans, y -> y.k = 4)) as bigint) as n_secret", "cast(size(spans) as bigint) as n_spans"]
    return found(docs.select("doc_id", "text")).selectExpr("doc_id", *counts, f"sha2({_text('base')}, 256) as base_sha256", f"{_text('spans')} as spans", *after)


def masked(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets, n_chars that of the new text; other columns stay.

    Spans that overlap one already masked only lengthen it. A null text stays null; rows stay as often as they repeat.
    """
    spans = found(docs).where("size(spans) > 0").select("d", "tk", "spans").dropDuplicates(["d", "tk"])
    row = "struct(" + ", ".join(f"`{c}`" for c in docs.columns) + ") as row"
    keyed = docs.selectExpr(row, f"{_ID} as d", "xxhash64(coalesce(text, '')) as tk")
    kinds = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    cut = f"""aggregate(spans, named_struct('p', 0, 'o', ''), (a, y) -> named_struct('p', greatest(a.p, y.e),
      'o', if(y.s < a.p, a.o, concat(a.o, substring(row.text, a.p + 1, y.s - a.p), array({kinds})[y.k]))), a -> concat(a.o, substring(row.text, a.p + 1)))"""
    masked_ = keyed.join(spans, ["d", "tk"], "left").selectExpr("row", f"explode(array(if(spans is null, row.text, {cut}))) as rest")
    new = {"text": F.col("rest"), "n_chars": F.length("rest").cast("long")}
    return masked_.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document; see `found` for odd rows."""
    return listed(table(spark, sf_dir, "documents"))
