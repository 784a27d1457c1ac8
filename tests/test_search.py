import random

import pytest

from fernpath.functions.regexes import RegexError
from fernpath.operators import index as idx
from fernpath.operators.search import fetched, search, sliced

DAY = 86400
ROWS = [
    (0, "/srv/mail/queue.lua", 300, 10 * DAY, 0o600, "text/x-lua"),
    (1, "/srv/mail/LETTERS.csv", 7_000_000, 40 * DAY, 0o640, "text/csv"),
    (2, "/data/maps/berlin.png", 45_000, 12 * DAY, 0o644, "image/png"),
    (3, "/data/maps/notes.csv", 45_001, 41 * DAY, 0o644, "text/csv"),
    (4, "/data/quay/tide-table", 0, 42 * DAY, 0o400, "application/octet-stream"),
    (5, "/boot/kernel-6.1", 9_999_999, 1 * DAY, 0o755, "application/octet-stream"),
]
SCHEMA = "doc_id long, full_path string, size long, mtime long, mode int, mime_type string"


@pytest.fixture(scope="module")
def files(spark):
    return idx.with_folds(spark.createDataFrame(ROWS, SCHEMA)).cache()


@pytest.fixture(scope="module")
def posted(files):
    return idx.all_postings(files).cache()


CASES = [
    (["maps"], {}, {2, 3}), (["letters"], {"ignore_case": True}, {1}), (["letters"], {}, set()), (["qu"], {}, {0, 4}), (["quay"], {"basename": True}, set()), (["q"], {}, {0, 4}),
    ([".csv"], {"mime": "text/csv", "size": "45KB-"}, set()), ([".csv"], {"size": "46KB-"}, {3}), ([], {"size": "7MB+"}, {1, 5}), ([], {"size": "45000"}, {2}),
    ([r"\d\.\d$"], {"regex": True}, {5}), ([r"(berlin|notes)\.\w{3}$"], {"regex": True}, {2, 3}), (["^/SRV"], {"regex": True, "ignore_case": True}, {0, 1}), (["tide", "kernel"], {}, {4, 5}),
    (["maps/"], {"basename": True}, set()), (["", "x"], {}, {0, 1, 2, 3, 4, 5}), ([], {"modified": "4w+", "now": 42 * DAY}, {0, 2, 5}), ([], {"modified": "2d-", "now": 42 * DAY}, {1, 3, 4}),
    ([], {"mime": "text/*"}, {0, 1, 3}), (["a"], {"mime": "image/*", "modified": "5w+", "now": 60 * DAY}, {2}),
]


@pytest.mark.parametrize("patterns, how, ids", CASES)
def test_fixture(files, posted, patterns, how, ids):
    assert {r.doc_id for r in search(files, patterns, **how).collect()} == ids
    assert {r.doc_id for r in search(files, patterns, index=posted, **how).collect()} == ids


def test_limit_and_errors(files):
    assert [r.doc_id for r in search(files, ["data"], limit=2).collect()] == [2, 3]
    assert search(files, ["data"], limit=0).count() == 0
    assert [r.doc_id for r in fetched(files, [4, 1]).collect()] == [1, 4] and sliced(files, 2, 3).count() == 3
    with pytest.raises(LookupError):
        fetched(files, [1, 6])
    for bad in ([], ["("], ["(?=x)"], ["[[:nope:]]"], ["(?U)a"]):
        with pytest.raises(RegexError):
            search(files, bad, regex=True)


def test_existing(spark, files, tmp_path):
    (tmp_path / "here").write_text("x")
    rows = spark.createDataFrame([(0, f"{tmp_path}/here"), (1, f"{tmp_path}/gone")], "doc_id long, full_path string")
    assert [r.doc_id for r in search(rows, ["e"], existing=True).collect()] == [0]


PATHS = ["/x/foo.rs", "/x/bar.rs", "/a/color.txt", "/n/v12.txt", "/u/é.txt", "/u/日本.txt", "/z/aq.md", "/nfd/abéx", "/MÜLLER", "/straße"]
SOUND = [
    (True, ["foo|bar"], {0, 1}), (True, ["foo.*", "color"], {0, 2}), (True, [r"\bfoo"], {0}), (True, ["[0-9]+"], {3}), (True, ["colou?r"], {2}), (True, ["v1{1,3}2"], {3}),
    (False, ["q", "foo"], {0, 6}), (False, ["", "foo"], set(range(10))), (False, ["é"], {4}), (False, ["日"], {5}), (False, ["日本"], {5}), (False, ["日本."], {5}), (False, ["abe"], {7}),
]


@pytest.fixture(scope="module")
def odd(spark):
    table = idx.with_folds(spark.createDataFrame([(k, p, 0, 0, 0, "") for k, p in enumerate(PATHS)], SCHEMA)).cache()
    return table, idx.all_postings(table).cache()


@pytest.mark.parametrize("regex, patterns, ids", SOUND)
def test_index_never_changes_an_answer(odd, regex, patterns, ids):
    assert {r.doc_id for r in search(odd[0], patterns, regex=regex).collect()} == ids
    assert {r.doc_id for r in search(odd[0], patterns, regex=regex, index=odd[1]).collect()} == ids


def test_case_folding(odd):
    assert {r.doc_id for r in search(odd[0], ["STRASSE"], ignore_case=True, index=odd[1]).collect()} == {9}
    assert {r.doc_id for r in search(odd[0], ["müller"], regex=True, ignore_case=True).collect()} == {8}


def test_random_patterns(odd):
    rng = random.Random(7)
    for _ in range(12):
        path = rng.choice(PATHS)
        start = rng.randrange(len(path))
        patterns = [path[start : start + rng.randint(0, 5)], rng.choice(["rs", "x", "zz", "/u/"])]
        how = {"ignore_case": rng.random() < 0.5, "basename": rng.random() < 0.3}
        plain = {r.doc_id for r in search(odd[0], patterns, **how).collect()}
        assert {r.doc_id for r in search(odd[0], patterns, index=odd[1], **how).collect()} == plain, (patterns, how)


def test_statistics(spark, files):
    stats = idx.gram_stats(idx.postings(files, 3)).first()
    assert stats.total_docs_indexed == idx.postings(files, 3).count() and stats.min_docs == 1
    assert tuple(idx.gram_stats(spark.createDataFrame([], "gram string, doc_id long")).first()) == (0, 0, 0, 0, 0)
