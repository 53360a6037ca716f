"""Whitening, clustering and decontamination against brute force."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from helmtrace.checks.compare import connect, difference
from helmtrace.llm import decontamination, vantage_clusters, whitening
from helmtrace.llm import whole_vectors as wv
from helmtrace.llm.queries import QUERIES
from helmtrace.llm.sql import ORACLE

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, component int, cluster string"
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", ["op12_decontamination", "op13_vantage_clusters"])
def test_query_against_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).sql(ORACLE[name]).df()) is None


# Exact sums


def test_sums_of_any_size_come_back_whole(spark):
    rows = [(i, [2**62 + i, -(2**62) - 7 * i, -i]) for i in range(50)]
    table = spark.createDataFrame(rows, "id long, x array<long>").select("x").repartition(7)
    found = wv.added(whitening._sums(table))
    assert [found[3, i, 0] for i in range(4)] == [50, *(sum(x[i] for _, x in rows) for i in range(3))]
    big = np.array([[2**40, 3], [-(2**40), 5]], dtype=np.int64)
    assert wv.gram(big).tolist() == [[2**81, -2 * 2**40], [-2 * 2**40, 34]]
    assert wv.square_sums(np.array([[2**62, 2**62]])).tolist() == [2**125]


# Whitening


@pytest.mark.parametrize("size,rank", [(1, 1), (2, 2), (7, 7), (24, 9), (64, 64), (65, 3)])
def test_cholesky_and_jacobi_against_a_dense_solver(size, rank):
    rng = np.random.default_rng(size)
    y = rng.normal(size=(300, rank)) @ rng.normal(size=(rank, size))
    a = y.T @ y / 300
    factor = whitening.pivoted_cholesky(a)
    assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a, atol=1e-9 * np.trace(a))
    components, values = whitening.one_sided_jacobi(factor)
    want = np.linalg.eigvalsh(a)[::-1][:rank]
    assert np.allclose(values, want, rtol=1e-10, atol=1e-12 * want[0])
    assert np.allclose(components.T @ components, np.eye(rank), atol=1e-10)
    assert np.allclose(a @ components, components * values, atol=1e-9 * want[0])


def test_equal_eigenvalues_and_a_zero_matrix():
    components, values = whitening.one_sided_jacobi(whitening.pivoted_cholesky(np.eye(6) * 4))
    assert np.allclose(values, 4) and np.allclose(components.T @ components, np.eye(6))
    assert whitening.pivoted_cholesky(np.zeros((4, 4))).shape == (4, 0)


def whitened_by_hand(rows, keep=4):
    x = {}
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            x.setdefault(i, []).append(tuple(math.floor(256 * float(c)) for c in v))
    fit = sorted({t for ts in x.values() for t in ts})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    d = len(s)
    centred = [[Fraction(c) - Fraction(t, n) for c, t in zip(f, s)] for f in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:keep], u[:, ::-1][:, :keep]
    out = {}
    for i, ts in x.items():
        for t in ts:
            dev = sum((n * c - m) ** 2 for c, m in zip(t, s))
            w = np.array([float(Fraction(c) - Fraction(m, n)) for c, m in zip(t, s)]) @ u / np.sqrt(e)
            out.setdefault(i, []).append((n, dev, w, e / np.trace(v)))
    return out


def test_whitening_against_exact_fractions(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(120, 12)) * np.linspace(3, 0.2, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(500 + i, base[7].tolist()) for i in range(60)] + [(3, base[50].tolist())]
    odd = [(900, None), (901, [None] + [1.0] * 11), (902, [NAN] * 12), (903, [INF] + [0.0] * 11)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], VECTORS).repartition(9)
    got = {}
    for r in whitening.whiten(table).collect():
        got.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    want = whitened_by_hand(rows)
    assert {i for i, _ in got} == set(want)
    sign = None
    for i, several in want.items():
        for n, dev, w, share in several:
            mine = got[i, dev]
            assert sorted(mine) == [1, 2, 3, 4] and all(mine[k]["n"] == n for k in mine)
            here = np.array([mine[k]["whitened"] for k in (1, 2, 3, 4)])
            sign = np.sign(here * w) if sign is None else sign
            assert np.allclose(here, w * sign, rtol=1e-8, atol=1e-9)
            assert np.allclose([mine[k]["explained"] for k in (1, 2, 3, 4)], share, rtol=1e-10)
            assert mine[1]["identity_error"] < 1e-9


def test_whitening_of_few_empty_and_unequal_vectors(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS)).collect()

    assert run([]) == [] and run([(1, None), (2, [])]) == []
    assert run([(1, [1.0, 2.0])] * 3) == []  # one distinct vector has no direction
    two = run([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (None, [0.0, 1.0])])
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in sorted(two, key=str)] == [
        (1, 1, 2, 65536), (2, 1, 2, 65536), (None, 1, 2, 65536),
    ]
    assert {round(abs(r["whitened"]), 12) for r in two} == {1.0} and {r["explained"] for r in two} == {1.0}
    mixed = run([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0]), (4, [7.0]), (5, [9.0])])
    assert {r["vec_id"]: r["n"] for r in mixed} == {1: 2, 2: 2, 3: 3, 4: 3, 5: 3}
    huge = run([(1, [1e30]), (2, [-1e30]), (3, [0.0])])
    assert len(huge) == 3 and {r["deviation"] for r in huge if r["vec_id"] != 3} == {None}


# Clustering


def clusters_by_hand(rows, k=16, rounds=3, size=64):
    x = [(i, [math.floor(64 * float(c)) for c in v]) for i, v in rows
         if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in x if i is not None)[:k]
    centres = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in x]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(x, found) if c == n]
            if mine:
                centres[n] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    found = assign() if centres else []
    for (i, _), (d, n) in zip(x, found):
        name = hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()
        out.append((i, n, d, sum(e for e, m in found if m == n), sum(e for e, _ in found), name))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["spread", "ties", "crowd", "few"])
def test_clusters_against_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    if kind == "spread":
        v = rng.normal(size=(400, 64)) / 8
    elif kind == "ties":  # few values: many equal distances and equal vectors
        v = rng.integers(-1, 2, size=(300, 64)) * (rng.random((300, 64)) < 0.05) / 64
    elif kind == "crowd":  # a third of all rows are copies
        v = np.concatenate([np.repeat(rng.normal(size=(1, 64)), 120, axis=0), rng.normal(size=(240, 64))])
    else:
        v = rng.normal(size=(5, 64))
    rows = [(i, r.astype(np.float32).tolist()) for i, r in enumerate(v)]
    rows += [(7000, None), (7001, [NAN] * 64), (7002, [0.5] * 63), (7003, [None] + [0.5] * 63), (7004, []), (None, rows[0][1])] + rows[:2]
    table = spark.createDataFrame([(i, r, 1, "x") for i, r in rows], VECTORS).repartition(6)
    got = vantage_clusters.cluster(table)
    assert sorted((tuple(r) for r in got.collect()), key=str) == clusters_by_hand(rows)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("clusters,size,wide", [(1, 2, 5), (40, 3, 4), (200, 8, 3), (300, 2, 2**60), (64, 4, 2**33)])
def test_tree_search_finds_the_nearest_of_all_centroids(clusters, size, wide):
    rng = np.random.default_rng(clusters)
    centroids = rng.integers(-wide, wide + 1, (clusters, size))
    x = rng.integers(-wide, wide + 1, (300, size))
    who, far = vantage_clusters.nearest(vantage_clusters.build(centroids), x)
    for row, w, f in zip(x.tolist(), who.tolist(), far.tolist()):
        assert (f, w) == min((sum((a - b) ** 2 for a, b in zip(row, c)), n) for n, c in enumerate(centroids.tolist()))


def test_tree_search_opens_few_nodes():
    rng = np.random.default_rng(0)
    centroids = rng.integers(-10_000, 10_000, (500, 2))
    calls = []
    own = vantage_clusters._distances
    vantage_clusters._distances = lambda x, c: (calls.append(len(x)), own(x, c))[1]
    try:
        tree = vantage_clusters.build(centroids)
        calls.clear()
        vantage_clusters.nearest(tree, rng.integers(-10_000, 10_000, (400, 2)))
    finally:
        vantage_clusters._distances = own
    assert sum(calls) < 400 * 500 / 5


def test_clusters_of_nothing_and_of_huge_components(spark):
    assert vantage_clusters.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    assert vantage_clusters.cluster(spark.createDataFrame([(None, [1.0] * 64, 1, "x")], VECTORS)).collect() == []
    table = spark.createDataFrame([(i, [s * 1e30] * 64, 1, "x") for i, s in enumerate([1, -1, 1])], VECTORS)
    out = {r["vec_id"]: r for r in vantage_clusters.cluster(table, clusters=2).collect()}
    assert len(out) == 3 and out[0]["cluster"] == out[2]["cluster"]


# Decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_by_hand(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination_by_hand(docs, items, n=10):
    wins = {}
    for item, text in items:
        w = words_by_hand(text)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add(None if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words_by_hand(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found |= wins[tuple(w[i : i + k])] - {None}
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    letters = ["ab", "cd", "ÄÖ", "x9", "日本", "q", "Zz", "naïve", "7"]

    def words(k):
        return [rng.choice(letters) + rng.choice(letters) for _ in range(k)]

    items = [(i, " ".join(words(rng.choice([14, 25, 60])))) for i in range(30)]
    items += [(50, "Tiny Short item"), (51, "one"), (52, ""), (53, None), (54, "..., !!"), (None, " ".join(words(12))), (3, "again the third item with ten or more words in its own text")]
    items += [(60, items[0][1]), (61, " ".join(items[1][1].split()[5:15]))]
    docs = [(i, " ".join(words(rng.randrange(0, 300)))) for i in range(60)]
    for i in range(60, 140):
        text = words(rng.randrange(0, 80))
        for _ in range(rng.randrange(1, 4)):
            part = (rng.choice(items)[1] or "").upper().split()
            a = rng.randrange(0, 8)
            at = rng.randrange(0, len(text) + 1)
            text[at:at] = part[a : a + rng.choice([4, 9, 10, 11, 40])]
        docs.append((i, rng.choice([" ", "\n", " -- ", ", "]).join(text)))
    docs += [(200, None), (201, ""), (202, "!!! ..."), (203, "Tiny SHORT\titem"), (204, "shortitem tiny short"), (205, "one"), (206, "on e")]
    docs += [(207, ("wort " * 50_000) + items[5][1] + " end" * 1000), (208, "x" * 3_000_000), (63, docs[63][1]), (None, items[7][1])]
    docs += [(300 + i, items[9][1]) for i in range(70)]
    return docs, items


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])
def test_contamination_against_brute_force(spark, limit):
    docs, items = corpus()
    table = spark.createDataFrame([(i, t, 0, "own") for i, t in docs], "doc_id long, text string, _n_hit int, _key string").repartition(5)
    bench = spark.createDataFrame([(t, i, "x") for i, t in items], "text string, item_id long, doc_id string")
    found = decontamination.find(table, bench, broadcast_bytes=limit)
    got = sorted(((r["doc_id"], r["_n_words"], r["_n_hit"], r["_items"]) for r in found.collect()), key=str)
    assert got == contamination_by_hand(docs, items)


def test_spans_cover_the_hits_and_leave_the_rest(spark):
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontamination.find(table, bench).collect():
        text, spans = r["text"] or "", [(s["start"], s["end"]) for s in r["_spans"]]
        assert sum(len(words_by_hand(text[s:e])) for s, e in spans) == r["_n_hit"]
        rest = "".join(text[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(text)]))
        assert rest == r["_clean"] and len(words_by_hand(rest)) >= r["_n_words"] - r["_n_hit"] - len(spans)
    kept = decontamination.remove(table, bench, "documents")
    assert kept.columns == ["doc_id", "text"]
    clean = [d for d, _, hit, _ in contamination_by_hand(docs, items) if not hit]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(clean, key=str)
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove(table, bench).collect()}
    assert cut[203] == "" and cut[206] == "on e" and cut[200] is None


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    out = decontamination.find(docs, bench).first()
    assert (out["_n_words"], out["_n_hit"], out["_items"], out["_clean"]) == (2, 0, [], "some words")
    assert decontamination.find(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).collect() == []
