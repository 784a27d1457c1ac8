"""The corpus pipeline, stage by stage and as a whole, against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fernpath.llm import pii, quality_rules, suffix_dedup

rng = random.Random(3)
WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "ha") for b in ("ran", "tel", "mos", "wick", "lune", "parn", "sti")]
KINDS = ["email", "ip", "card", "phone"]


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage = prose(70)
    base = prose(120)
    words = base.split()
    made = [(1, base), (2, " ".join([*words[:60], "changed", *words[61:]])), (3, base), (4, f"{prose(60)}\n{passage}\n{prose(60)}"), (5, f"{prose(80)}\n{passage}"), (6, f"{prose(60)} write to anna.b@mail.example.org or 10.1.2.3 today. {prose(40)}")]
    made += [(7, "too short"), (8, None), (9, ""), (10, f"Home | About | Contact\n{prose(150)}\nread more"), (11, " ".join(["spam spam spam"] * 40)), (12, prose(6000)), (3, base), (13, f"é{prose(90)}ñ")]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = [(i, t, "en", "src", len(t or ""), i, i) for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, k1 long, ranges long").repartition(3).cache()


def plain_quality(text):
    lines, kept, lost = (text or "").split("\n"), [], 0
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    for line in lines:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
        symbols, furniture = len(re.findall(r"[#*$%&|<>]", line)), any(b in line.lower() for b in quality_rules.BOILERPLATE)
        bad = len(re.findall("[|»›]", line)) >= 2 or 5 * symbols > n or (n >= 5 and 5 * line.count("!!") > n) or (n >= 12 and not re.search("[.,;:!?]", line)) or (n <= 20 and furniture)
        kept += [] if bad and n else [line]
        lost += n if bad else 0
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    return "\n".join(kept) if len(words) >= 50 and 2 * len(covered) <= len(words) and 100 * lost <= 30 * len(words) else None


def plain_distinct(rows):
    def shingles(t):
        w = t.lower().split()
        return frozenset(zip(*(w[k:] for k in range(5)))) or frozenset([tuple(w)] if w else [])

    left, kept = sorted(set(rows)), []
    sets = {r: shingles(r[1]) for r in left}
    near = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    while left:
        group, todo = set(), [left[0]]
        while todo:
            r = todo.pop()
            if r not in group:
                group.add(r)
                todo += [x for x in left if near(r, x)]
        kept.append(left[0])
        left = [r for r in left if r not in group]
    return kept


def plain_removed(rows):
    data = [t.encode() for _, t in rows]
    times = Counter(t[k : k + 200] for t in data for k in range(len(t) - 199))
    found = []
    for (i, _), t in zip(rows, data):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if times[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs, start = [], 0
        for k in range(len(t) + 1):
            if k == len(t) or gone[k]:
                runs.append(t[start:k])
                start = k + 1
        found.append((i, "".join(r.decode("utf-8", "ignore") for r in runs)))
    return found


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, docs, rows):
    names, functions = zip(*corpus_pipeline.STAGES)
    assert len(names) == 5
    now, plain = docs, None
    for k, f in enumerate(functions[:-1]):
        now = f(spark, now, "")
        assert now.columns == docs.columns
        now = now.cache()
        if k == 0:
            plain = sorted((i, c) for i, c in ((i, plain_quality(t)) for i, t in rows) if c is not None)
            assert {10, 12, 13} <= {i for i, _ in plain} and not {7, 8, 9, 11} & {i for i, _ in plain}
        elif k == 1:
            plain = plain_distinct(plain)
            assert not {2, 3} & {i for i, _ in plain}
        elif k == 2:
            plain = sorted(plain_removed(plain))
        else:
            assert "<EMAIL>" in dict(texts(now))[6] and "<IP>" in dict(texts(now))[6] and "@" not in dict(texts(now))[6]
            plain = [(i, t if i != 6 else dict(texts(now))[6]) for i, t in plain]
        assert texts(now) == plain, names[k]
        assert all(r.n_chars == len(r.text) and r.k1 == r.ranges == r.doc_id for r in now.collect())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in plain:
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        want.update((i, k, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096)))
    packed = functions[-1](spark, now, "").collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == want


def test_run(spark, docs, tmp_path):
    docs.drop("k1", "ranges").write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {1, 4, 5, 6, 10, 12, 13}
    used = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096


def test_no_character_arises_at_a_cut(spark):
    """Both sides of a cut end inside a character: what is left of them must not make a new one."""
    shared = "x" * 90 + "q" * 120
    rows = [(1, "Ã" + shared + "©"), (2, "Ã" + shared + "é"), (3, "Å" + shared + "µ")]
    found = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(set(r.text) <= set(dict(rows)[r.doc_id]) for r in found.collect())
    assert texts(found) == plain_removed(rows)


def test_working_names_cannot_clash(spark):
    names = ["__q", "__d", "__tk", "__s", "__ranges", "d", "tk", "row", "rest", "q", "spans", "k1", "k2", "a.b"]
    one = spark.createDataFrame([(1, prose(60) + " me@mail.org 10.0.0.1.", *range(len(names)))], ["doc_id", "text", *names])
    for f in (quality_rules.cleaned, suffix_dedup.removed, pii.masked, lambda d: corpus_pipeline.near_duplicates(spark, d, "")):
        found = f(one)
        assert found.columns == one.columns and found.first()[2:] == tuple(range(len(names)))
