"""Vector dedup, components and the pipeline against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helmtrace.checks.compare import connect, difference
from helmtrace.llm import embedding_dedup, pii, quality_model, shingle_dedup, simhash
from helmtrace.llm.components import components
from helmtrace.llm.queries import QUERIES
from helmtrace.llm.sql import ORACLE

SMALL = "/root/testdata/sf0.001"


def labels_by_hand(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components_of_random_graphs_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)] + [(5, 5), (7, 9), (7, 9), (9, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert found == labels_by_hand({n for e in real for n in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest_lattice_point_beats_all_neighbours():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 3, (500, 8))
    near = embedding_dedup.nearest_e8(x)
    doubled = np.rint(near * 2)
    assert np.allclose(doubled, near * 2) and (np.abs(doubled[:, :1] - doubled) % 2 == 0).all() and (near.sum(axis=1) % 2 == 0).all()
    steps = embedding_dedup.shortest_e8()
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    own = ((x - near) ** 2).sum(axis=1)
    assert all((((x - near)[:, None, :] - steps[None]) ** 2).sum(axis=2).min(axis=1) >= own - 1e-9)


def vectors(seed=3):
    """Clusters about 0.9 to 1.0 apart, copies, scaled copies and strangers."""
    rng = np.random.default_rng(seed)
    rows = []
    for size, noise in [(40, 0.02), (30, 0.25), (60, 0.33), (700, 0.1)] + [(2, n) for n in np.linspace(0.05, 0.45, 120)]:
        center = rng.normal(size=64)
        for _ in range(size):
            v = center / np.linalg.norm(center) + noise * rng.normal(size=64) / 8
            rows.append(v)
    rows += [rows[0], rows[0], rows[5] * 3.0] + list(rng.normal(size=(400, 64)))
    return np.array(rows, dtype=np.float32)


def test_links_reach_the_recall_and_are_never_false(spark):
    rows = vectors()
    table = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, name string, w int")
    found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table).collect()}
    unit = rows.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    got = np.array([found[i]["n_links"] for i in range(len(rows))])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()
    hand = labels_by_hand(range(len(rows)), list(zip(*np.nonzero(linked))))
    assert np.mean([found[i]["component_id"] == hand[i] for i in range(len(rows))]) > 0.95
    assert all(found[i]["kept"] == (found[i]["component_id"] == i) for i in range(len(rows)))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 0.0]), (None, [0.0, 5.0]), (None, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = embedding_dedup.near_duplicates(table).collect()
    assert len(out) == len(rows)
    links = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert all(links[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10))
    assert links[7] == (3, 7, True) and links[8] == links[9] == (3, 7, False)
    assert links[None] == (0, None, False)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    assert difference(found, connect(SMALL).sql(ORACLE[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_cover_their_whole_table(spark, name):
    out = QUERIES[name](spark, SMALL)
    key, name = next((k, t) for k, t in {"page_id": "pages", "vec_id": "embeddings", "doc_id": "documents"}.items() if k in out.columns)
    source = spark.read.parquet(f"{SMALL}/{name}.parquet")
    assert {r[0] for r in out.select(key).distinct().collect()} == {r[0] for r in source.select(key).collect()}


def test_pipeline_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "personal_data", "packed"]
    forest = quality_model.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = stages["quality"](spark, docs, SMALL)
    rows = docs.collect()
    scores = forest.score(np.array([quality_model.document_statistics(r["text"]) for r in rows]))
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r, s in zip(rows, scores) if s >= 0.5}

    from tests.llm.test_text_operators import groups_by_hand, lines_by_hand, print_by_hand, texts_of

    good = good.cache()
    cut = stages["lines"](spark, good, SMALL).cache()
    want = {k: v[2] for k, v in lines_by_hand(texts_of(good)).items()}
    assert texts_of(cut) == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    alone = stages["near_duplicates"](spark, cut, SMALL).cache()
    groups = groups_by_hand({k: print_by_hand(t) for k, t in want.items()})
    assert {r["doc_id"] for r in alone.collect()} == set(groups.values())
    clean = stages["personal_data"](spark, alone, SMALL)
    for r in clean.collect():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    for frame in (good, cut, alone, clean):
        assert frame.columns == docs.columns and dict(frame.dtypes) == dict(docs.dtypes)
    assert {r[0] for r in stages["packed"](spark, clean, SMALL).select("doc_id").distinct().collect()} == set(groups.values())
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_survives_nulls_and_nothing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "a text of a few words here", None, None, 5), (2, "", "en", "s", 0)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SMALL)
            assert out.count() >= 0
            if name in ("lines", "personal_data"):
                assert out.count() == table.count()


def test_simhash_keeps_one_of_a_large_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words in every one of them "), F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("id").cast("string"))).alias("text"))
    found = simhash.near_duplicates(docs)
    assert found.where("doc_id % 3 = 0 AND component_id != 0").count() == 0


def planted_edits(seed=5):
    """Texts of 300 words with 1 to 10 % of the words changed, spread out or in one run, and a crowd of near copies."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for share in range(1, 11):
        for run in (False, True):
            base, n = words(300), 3 * share
            places = range(100, 100 + n) if run else rng.sample(range(300), n)
            edited = [f"x{i}" if i in places else w for i, w in enumerate(base)]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(edited))]
    base = words(120)
    for i in range(60):
        edited = list(base)
        for at in rng.sample(range(120), rng.randrange(6)):
            edited[at] = f"y{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(edited)))
    return rows


def groups_of_sets(rows):
    sets = {i: shingle_dedup.shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return labels_by_hand(ids, links)


def test_near_copies_with_planted_edits_leave_the_pipeline(spark):
    rows = planted_edits()
    want = groups_of_sets(rows)
    assert want[1] == 0 and want[3] == 2 and len(set(want.values())) < len(rows) - 30
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["component_id"] for r in shingle_dedup.near_duplicates(docs).collect()} == want
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SMALL)
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())


def template_crowd(kinds, own, shared=200, seed=8):
    """Texts with a template in common and ``own`` words of their own each, which all keys by the template throw together."""
    rng = random.Random(seed)
    template = [f"t{rng.randrange(10**6)}" for _ in range(shared)]
    return [(i, " ".join(template + [f"o{i}x{k}" for k in range(own[i % len(own)])])) for i in range(kinds)]


def members_of(spark, rows, component):
    made = [(i, component(i), sorted(np.array(shingle_dedup.shingle_hashes(t.encode())).view(np.int64).tolist())) for i, t in rows]
    return spark.createDataFrame(made, "v long, component long, hashes array<long>")


@pytest.mark.parametrize("component", [lambda i: i, lambda i: i % 7, lambda i: 0 if i % 5 else i], ids=["apart", "mixed", "main"])
def test_prefix_pairs_lose_no_link_between_components(spark, component):
    rng = random.Random(11)
    rows = planted_edits() + [(5000 + i, t) for i, t in template_crowd(50, [3, 9, 20, 30, 40, 60])]
    base = [f"b{k}" for k in range(400)]
    rows += [(6000 + i, " ".join(base[: rng.randrange(300, 401)])) for i in range(40)]  # one inside the other, of many sizes
    rows += [(7000 + i, f"tiny {i % 3} text") for i in range(9)] + [(7100, "one " * 20_000), (7101, "one " * 15_000 + "two")]
    sets = {i: shingle_dedup.shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = {tuple(sorted(r)) for r in shingle_dedup.prefix_pairs(members_of(spark, rows, component)).collect()}
    assert {(a, b) for a, b in links if component(a) != component(b)} <= found
    assert all(component(a) != component(b) for a, b in found)


def test_texts_without_a_partner_go_before_pairs_are_sought(spark):
    rows = planted_edits() + [(5000 + i, t) for i, t in template_crowd(50, [3, 9, 60, 100])] + [(9000, ""), (9001, "")]
    members = members_of(spark, rows, lambda i: i)
    kept = [r["v"] for r in shingle_dedup.with_partners(members).collect()]
    sets = {i: shingle_dedup.shingles(t) for i, t in rows}
    held = Counter(h for s in sets.values() for h in s)
    assert sorted(kept) == [i for i, s in sorted(sets.items()) if sum(held[h] > 1 for h in s) >= 0.8 * len(s) - 1e-9]
    linked = {i for a, b in combinations(sets, 2) if 0.8 * len(sets[a] | sets[b]) - 1e-9 <= len(sets[a] & sets[b]) > 0 for i in (a, b)}
    assert linked <= set(kept) and 0 < len(kept) < len(rows)
    assert shingle_dedup.with_partners(members.limit(0)).count() == 0


def test_a_crowd_of_unlike_texts_of_one_template_makes_no_pairs(spark):
    # 200 shared words and 40 or 100 own ones: similarity 0.7 and 0.5, so no pair is a link.
    rows = template_crowd(3_000, [40, 100])
    assert shingle_dedup.prefix_pairs(members_of(spark, rows, lambda i: i)).count() == 0


def test_near_duplicates_in_a_crowd_of_unlike_texts(spark):
    rows = template_crowd(300, [100]) + [(1000 + i, t.replace("o7x3 ", "changed ")) for i, t in template_crowd(300, [100])[7:8]]
    rows += [(2000, None), (2001, ""), (2002, "  \n"), (2003, "word " * 60_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, hashes int")
    found = {r["doc_id"]: r["component_id"] for r in shingle_dedup.near_duplicates(docs).collect()}
    assert found == {i: {1007: 7, 2001: 2000, 2002: 2000}.get(i, i) for i, _ in rows}
    empty = docs.limit(0)
    assert shingle_dedup.near_duplicates(empty).collect() == [] and shingle_dedup.dedup(empty).columns == docs.columns


def test_each_text_of_an_id_stays_or_goes_by_itself_in_the_pipeline(spark):
    copy, own = "one two three four five six seven", "a text that no other row of the table has"
    rows = [(1, copy), (2, copy.upper()), (2, own), (None, copy), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, shingle_dedup.dedup(docs).collect()), key=str) == sorted([(1, copy), (2, own), (None, copy), (3, "")], key=str)


def test_each_text_is_cut_into_shingles_once(spark, capsys):
    """Spark must not call the function a second time below the first, for a filter: that doubles work and Python workers."""
    texts = [f"{own} " + " ".join(f"w{i}" for i in range(20 + own)) for own in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    nodes = [(100 + i, *shingle_dedup._name(texts[i].encode()), i) for i in range(0, 600, 5)]
    named = spark.createDataFrame(nodes, "v long, hi long, lo long, first_id long")
    found = shingle_dedup.shingle_sets(docs, named, "doc_id", "text", 5)
    capsys.readouterr()
    found.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    want = {v: shingle_dedup.shingle_hashes(texts[i].encode()).view(np.int64).tolist() for v, _, _, i in nodes}
    assert {r["v"]: r["hashes"] for r in found.collect()} == want


def copies_without_a_key(seeds=(7035, 29272, 34847)):
    """Pairs of 13 words whose last words differ: 8 of 10 shingles in common, by chance no key of any band."""
    rows = []
    for seed in seeds:
        rng = random.Random(seed)
        words = [f"w{rng.randrange(10**6)}" for _ in range(13)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-1] + ["other"]))]
    return rows


def test_near_copies_that_share_no_key_leave_the_pipeline(spark):
    rows = copies_without_a_key()
    keys = [shingle_dedup.band_keys(shingle_dedup.shingle_hashes(t.encode())) for _, t in rows]
    assert not any((a == b).any() for a, b in zip(keys[::2], keys[1::2]))
    rows += [(100, "texts of another kind that have no copy in the table"), (101, None), (102, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 100: 100, 101: 101, 102: 101}
    assert {r["doc_id"]: r["component_id"] for r in shingle_dedup.near_duplicates(docs).collect()} == want
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SMALL).collect()} == set(want.values())


def test_near_duplicates_at_a_lower_similarity(spark):
    rng = random.Random(21)
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        kept = rng.randrange(36, 48)  # similarities of about 0.4 to 0.65
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:kept] + [f"x{i}y{k}" for k in range(60 - kept)]))]
    sets = {i: shingle_dedup.shingles(t) for i, t in rows}
    want = labels_by_hand(sets, [(a, a + 1) for a in range(0, 120, 2) if len(sets[a] & sets[a + 1]) >= 0.5 * len(sets[a] | sets[a + 1])])
    assert 20 < 120 - len(set(want.values())) < 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in shingle_dedup.near_duplicates(docs, least=0.5).collect()} == want


def test_fronts_lose_no_link_between_components(spark):
    rows = planted_edits() + [(5000 + i, t) for i, t in template_crowd(20, [3, 9, 40, 60])]
    rows += [(7000 + i, f"tiny {i % 3} text") for i in range(6)] + [(7100, "one " * 9_000), (7101, "one " * 7_000 + "two"), (7102, "")]
    rows += [(8000 + i, " ".join(f"s{i}x{k}" for k in range(5 + i))) for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, txt string").repartition(3)
    counts = shingle_dedup.shingle_counts(docs, "txt")
    made = {i: shingle_dedup.shingle_hashes(t.encode()) for i, t in rows}
    first = np.concatenate(list(made.values())) >> np.uint64(64 - shingle_dedup.COUNTED_BITS)
    assert (counts == np.bincount(first.astype(np.int64), minlength=1 << shingle_dedup.COUNTED_BITS)).all()
    named = [(i, *shingle_dedup._name(t.encode()), i, i % 7, len(made[i])) for i, t in rows]
    named = spark.createDataFrame(named, "v long, hi long, lo long, first_id long, component long, n int")
    sets = {i: set(made[i].tolist()) for i in made}
    for least in (0.8, 0.5):
        links = [(a, b) for a, b in combinations(sets, 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
        found = shingle_dedup.fronts(docs, named, "id", "txt", 5, least)
        met = {r["v"] for r in shingle_dedup.meeting(found, least).collect()}
        assert {i for pair in links if pair[0] % 7 != pair[1] % 7 for i in pair} <= met and len(met) < len(rows) - 30
