"""Vector codes and nearest neighbours against plain versions, on whole small tables and on odd rows."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.llm import vector_codes, vector_search

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string, ids int"


def odd_rows():
    """Copies, ties, halves, null and infinite components, other lengths, a null id and an id twice."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 8) / 4], i % 3, "x", 1) for i in range(300)]
    rows += [(1000 + i, rows[7][1], None, "x", 1) for i in range(120)]
    rows += [(20, rows[20][1], 2, "x", 1), (2000, [math.nan] * 8, 1, "x", 1), (2020, None, 1, "x", 1), (2040, [0.5, None] * 4, 1, "x", 1), (2060, [math.inf] + [0.0] * 7, 1, "x", 1), (2080, [], 1, "x", 1), (2100, [0.0] * 8, 1, "x", 1), (2120, [1.0] * 5, 1, "x", 1), (None, [0.25] * 8, 5, "x", 1), (-40, [-0.3] * 8, 1, "x", 1)]
    return rows


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label, *_ in rows if v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = 8 // parts
    cut = [[v[p * size : p * size + size] for p in range(parts)] for _, _, v in kept]
    books = [[cut[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        found = [[min((apart(x, c), e) for e, c in enumerate(books[p])) for p, x in enumerate(v)] for v in cut]
        if step < rounds:
            for p in range(parts):
                members = defaultdict(list)
                for v, f in zip(cut, found, strict=True):
                    members[f[p][1]].append(v[p])
                for e, xs in members.items():
                    books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    by_label = defaultdict(int)
    for (_, label, _), f in zip(kept, found, strict=True):
        by_label[label] += sum(d for d, _ in f)
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), by_label[label]) for (i, label, _), f in zip(kept, found, strict=True)), key=repr), digest


@pytest.mark.parametrize("count", [431, 90, 1])
def test_codes(spark, count):
    rows = odd_rows()[-count:]
    coded, books = vector_codes.compress_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = vector_codes.with_label_error(coded).select("vec_id", F.lower(F.hex("codes")), "error", "label_error").collect()
    want, digest = plain_codes(rows)
    assert sorted((tuple(r) for r in got), key=repr) == want and books.digest() == digest


def test_codes_without_rows(spark):
    coded, books = vector_codes.compress_vectors(spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA))
    assert books is None and vector_codes.with_label_error(coded).count() == 0


def test_huge_components_count_as_the_limit(spark):
    rows = [(1, [1e30, -1e30, 0.0, 1.0], 1, "", 1), (2, [0.0] * 4, 1, "", 1), (3, [3e38] * 4, 1, "", 1)]
    coded, _ = vector_codes.compress_vectors(spark.createDataFrame(rows, SCHEMA), parts=2, entries=1)
    assert all(0 <= r["error"] < 2**63 for r in coded.collect())
    assert vector_codes.with_label_error(coded).count() == 3


def test_exponion_search_is_exact_from_any_start():
    rng = np.random.default_rng(1)
    for spread in (3, 1000, 2**27):
        book, x = rng.integers(-spread, spread, (50, 4)), rng.integers(-spread, spread, (700, 4))
        apart = ((x[:, None, :] - book[None]) ** 2).sum(2)
        found, best = vector_codes.Exponion(book).nearest(x, rng.integers(0, 50, 700))
        assert (found == apart.argmin(1)).all() and (best == apart.min(1)).all()


def plain_neighbours(rows, k=20, every=20):
    kept = sorted({(i, tuple(v)) for i, v, *_ in rows if i is not None and v and len(v) == len(rows[0][1]) and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    x = np.array([v for _, v in kept], np.float32).astype(np.float64)
    ids = np.array([i for i, _ in kept])
    out = []
    for i, v in kept:
        if i % every == 0:
            s = (np.array(v, np.float32).astype(np.float64) * x).sum(1)
            order = [r for r in np.lexsort((ids, -s)) if ids[r] != i][:k]
            out += [(i, n + 1, int(ids[r]), float(s[r])) for n, r in enumerate(order)]
    return out


def test_neighbours_when_all_leaves_are_visited(spark):
    rows = odd_rows()
    rows = [r for r in rows if r[0] != 20 or r[1] != rows[20][1]] + [rows[20]] * 2
    got = vector_search.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3), target=1.0, leaf_rows=16)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = sorted(tuple(r) for r in got.collect())
    want = sorted(plain_neighbours(rows))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    # The calibrated visits suffice for the sampled queries, and these are all of them.
    assert got == want


def test_few_and_no_vectors(spark):
    few = [(i, [1.0, float(i)], 1, "", 1) for i in range(0, 100, 20)]
    got = sorted(tuple(r) for r in vector_search.nearest_neighbours(spark.createDataFrame(few, SCHEMA)).collect())
    assert got == sorted(plain_neighbours(few)) and len(got) == 20
    for rows in ([(20, [1.0], 1, "", 1)], [(1, [1.0], 1, "", 1)], [(20, [0.0], 1, "", 1)], []):
        assert vector_search.nearest_neighbours(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_recall_and_scores(spark, sf_dir, monkeypatch):
    """Every row is indexed, bins and blocks are many, and the mean recall against all pairs is 0.9 at least."""
    monkeypatch.setattr(vector_search, "BIN_BYTES", 60 * 8 * 64)
    monkeypatch.setattr(vector_search, "QUERY_BYTES", 7 * 8 * 64)
    monkeypatch.setattr(vector_search, "SLICE", 3)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding").collect()]
    want = defaultdict(list)
    for q, _, i, s in plain_neighbours(rows):
        want[q].append((i, s))
    found = defaultdict(list)
    for r in sorted(vector_search.nearest_neighbours(vectors, sample=200, leaf_rows=8, calibration=12).collect()):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    assert np.mean([len(set(found[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in found.values())


def test_leaves_larger_than_a_bin(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(vector_search, "BIN_BYTES", 9 * 8 * 64)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in vector_search.nearest_neighbours(vectors, leaf_rows=100, target=1.0, calibration=500).collect()) == sorted(plain_neighbours(rows))


def test_tree_splits_and_orders():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(900, 6))
    tree = vector_search.grow(points, 40)
    assert 40 <= tree.leaves <= 48 and set(tree.leaf_of(points)) == set(range(tree.leaves))
    for order in tree.orders(points[:20], 0.5, tree.leaves):
        assert sorted(order) == list(range(tree.leaves))
    held = np.bincount(tree.leaf_of(points), minlength=tree.leaves)
    assert all(held[o].sum() >= 100 for o in tree.orders(points[:20], 0.5, 1, held, 100))
    assert vector_search.grow(np.ones((1, 3)), 9).leaves == 1
