"""The n-gram Jaccard join where rows share ids or texts, and in a large group of near copies."""

import random

from fernpath.llm import jaccard_join

rng = random.Random(5)
A, B, C = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")


def test_rows_that_share_an_id_are_one_node(spark):
    rows = [(3, A), (5, A), (5, B), (9, B), (9, ""), (11, C), (12, None), (12, C), (13, None), (None, A), (None, "odd one here"), (20, ""), (20, "x y")]
    found = [tuple(r) for r in jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    label = {3: 3, 5: 3, 9: 3, 11: 11, 12: 11, 13: 13, 20: 20}
    assert len(found) == len(rows)
    assert {(d, c) for d, _, c in found if d is not None} == set(label.items())
    assert sorted((n, c) for d, n, c in found if d is None) == sorted([(58, 3), (1, None)], key=lambda x: x[0])


def test_distinct_loses_no_text(spark):
    rows = [(3, A, 1), (5, A, 2), (5, B, 3), (9, B, 4), (9, B, 5), (7, C, 6), (7, C, 6), (8, None, 7), (8, None, 8), (6, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    found = jaccard_join.distinct(docs)
    assert found.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in found.collect()) == sorted([(3, A), (5, B), (7, C), (8, ""), (6, "")])


def test_large_group_of_near_copies(spark):
    """700 near copies, most of them less similar than needed: groups as by comparing all, through few pairs."""
    base, texts = [f"w{k}" for k in range(150)], {}
    for i in range(700):
        words = list(base)
        for k in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5, 7, 9])):
            words[k] = rng.choice([f"x{i}.{k}", "same", f"y{rng.randrange(30)}"])
        texts[i] = " ".join(words)
    sets = {i: frozenset(zip(w, w[1:], w[2:])) for i, w in ((i, t.split()) for i, t in texts.items())}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    found = jaccard_join.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == label
