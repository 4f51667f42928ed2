import re
from collections import defaultdict

import pytest

from gridspan.llm import jaccard_join


def naive(rows):
    sets = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc_id, frozenset([tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))]) if words else frozenset()))
    parent = {}

    def root(s):
        while parent.setdefault(s, s) != s:
            s = parent[s]
        return s

    by_shingle, distinct = defaultdict(set), {s for _, s in sets if s}
    for s in distinct:
        for x in s:
            by_shingle[x].add(s)
    for s in distinct:
        for o in set().union(*(by_shingle[x] for x in s)):
            if 100 * len(s & o) >= 75 * len(s | o):
                parent[root(s)] = root(o)
    names = {}
    for doc_id, s in sets:
        if s and doc_id is not None:
            names[root(s)] = min(names.get(root(s), doc_id), doc_id)
    return sorted(((d, len(s), names.get(root(s), d) if s else d) for d, s in sets), key=repr)


@pytest.mark.parametrize("table", ["near_docs", "documents", "odd_docs"])
def test_components_equal_brute_force(request, table):
    docs = request.getfixturevalue(table)
    want = naive([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted((tuple(r) for r in jaccard_join.link_components(docs).collect()), key=repr) == want


@pytest.mark.parametrize("boundary", [3, 12, 64])
def test_every_boundary_gives_the_same(near_docs, monkeypatch, boundary):
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *_: boundary)
    monkeypatch.setattr(jaccard_join, "LATE_COUNT", 4)
    want = naive([(r["doc_id"], r["text"]) for r in near_docs.collect()])
    assert sorted((tuple(r) for r in jaccard_join.link_components(near_docs).collect()), key=repr) == want


def test_boundary_follows_cost():
    sizes = {8: 1000, 20: 1000, 128: 10}
    assert jaccard_join.choose_boundary(sizes, 0.0) == 3
    assert jaccard_join.choose_boundary(sizes, 500.0) > 20


def test_keep_first(near_docs, empty_docs):
    want = {c for _, _, c in naive([(r["doc_id"], r["text"]) for r in near_docs.collect()])}
    kept = jaccard_join.keep_first(near_docs)
    assert kept.columns == near_docs.columns and {r["doc_id"] for r in kept.collect()} == want
    assert jaccard_join.link_components(empty_docs).count() == 0


def test_keep_first_decides_by_row(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    near = lambda name: text(name) + " more"
    rows = [
        *[(1, text("a"), "1"), (1, text("a"), "2"), (2, near("a"), "3"), (5, near("a"), "4"), (None, text("a").upper(), "5")],
        *[(5, text("b"), "6"), (6, text("b"), "7")],
        *[(None, text("c"), "8"), (None, text("c"), "9"), (None, near("c"), "10")],
        *[(7, "", "11"), (7, " ", "12"), (None, None, "13")],
        *[(8, text("d"), "14"), (8, near("d"), "15"), (8, text("e"), "16"), (9, text("f"), "17"), (None, text("g"), "18"), (10, text("f"), "19")],
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string")
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(int(r["odd.name"]) for r in kept.collect())
    groups = [{1, 2}, {6}, {8, 9, 10}, {11}, {12}, {13}, {14, 15}, {16}, {17}, {18}]
    assert len(got) == len(groups) and all(len(g & set(got)) == 1 for g in groups)


def test_words_of_like_structure_are_told_apart(spark):
    # Words over two letters that polynomial hashes modulo a power of two confuse, whatever their base.
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"one two {a} four five"), (2, f"one two {a.translate(str.maketrans('ab', 'ba'))} four five")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.link_components(docs).collect()) == [(1, 1, 1), (2, 1, 2)]


def test_a_list_of_very_many_sets_is_dealt_into_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for group in range(14):
        own = [f"g{group}w{i}" for i in range(70)]
        for k in range(10):
            words = shared + own[: 60 + k]
            words[rng.randrange(45, 95)] = f"x{group}y{k}"
            rows.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "LATE_COUNT", 10**9)
    want = naive([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((tuple(r) for r in jaccard_join.link_components(docs).collect()), key=repr) == want
    assert len({c for _, _, c in want}) < 100
