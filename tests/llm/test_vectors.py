"""Vector operators against brute force, and the pipeline as a whole."""

from collections import Counter

import numpy as np
import pytest

from wattloom.llm import common, topk, vectors


def plain_links(es, threshold=0.95):
    ok = [i for i, e in enumerate(es) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, root = Counter(), list(range(len(es)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p in ok:
        for q in ok:
            if p < q and len(es[p]) == len(es[q]):
                a, b = np.array(es[p], float), np.array(es[q], float)
                if (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) >= threshold:
                    links[p] += 1
                    links[q] += 1
                    a, b = sorted((find(p), find(q)))
                    root[b] = a
    return {i: (links[i], find(i)) for i in range(len(es))}


@pytest.mark.parametrize("piece", [1024, 8])
def test_near_vectors(spark, monkeypatch, piece):
    monkeypatch.setattr(vectors, "PIECE", piece)
    rng = np.random.default_rng(0)
    b = rng.normal(size=(4, 64))
    es = [(b[i % 4] + rng.normal(size=64) * [0.05, 0.1, 0.12, 0.15][i // 4 % 4]).astype(np.float32).tolist() for i in range(120)]
    es += [es[0]] * 4 + [None, [], [0.0] * 64, [1.0, None] + [0.0] * 62, [float("nan")] * 64, [1.0, 2.0], [2.0, 4.0], [1e38] * 64, [float("inf")] * 64]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in enumerate(es)], "vec_id long, embedding array<float>, class string, rows int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    want = plain_links(es)
    assert set(got) == set(want)
    true, found = sum(n for n, _ in want.values()), sum(n for n, _ in got.values())
    assert found <= true and found >= 0.98 * true
    assert all(got[i] == want[i] for i in range(120, len(es)) if want[i][0] == 0 or i > 124)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_equal_vectors_and_null_ids(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [5.0, -7.0])],
                               "vec_id long, embedding array<double>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert got == Counter({(3, 3, 3, True): 1, (None, 3, 3, False): 1, (5, 3, 3, False): 2, (None, 0, None, True): 1})


def test_topk_against_a_scan(spark):
    rng = np.random.default_rng(2)
    es = rng.normal(size=(350, 64)).astype(np.float32).tolist()
    es[101], es[102], es[150] = es[100], es[100], None
    df = spark.createDataFrame([(i, e, 0) for i, e in enumerate(es)], "vec_id long, embedding array<float>, code int")
    got = {}
    for r in topk.nearest_vectors(df, 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    for q in (0, 100, 200, 300):
        code = lambda e: np.array(e) > 0
        d = sorted((int((code(es[q]) != code(e)).sum()), i) for i, e in enumerate(es) if e is not None and i != q)[:7]
        assert sorted(got[q]) == [(k + 1, *x) for k, x in enumerate(d)]
    few = topk.nearest_vectors(df.filter("vec_id < 4"), 7).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert topk.nearest_vectors(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (500, None)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}}


def test_ranks_without_gathering(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(k, v) for k in ("a", None) for v in range(50)], "k string, v int")
    out = common.rank_within(df, ["k"], ["v"], F.pmod("v", F.lit(4)), "nth").collect()
    for k in ("a", None):
        own = sorted((r.v % 4, r.v, r.nth) for r in out if r.k == k)
        assert [n for *_, n in own] == list(range(50))


def test_pipeline_takes_effect(spark, sf):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash", "suffix_dedup", "mixing", "packing"] and p.ORACLE_SQL is None
    clean = p.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns and 0.8 * docs.count() < clean.count() <= docs.count()
    out = p.run(spark, sf)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert ids <= {r.doc_id for r in clean.select("doc_id").collect()} and out.count() >= len(ids) > 0


def plain_near_copies(docs):
    """The doc_id kept of each group of texts at 0.8 or more, all pairs compared."""
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc)
    return sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=lambda d: (d is None, d))


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline as p
    rng = np.random.default_rng(5)
    docs = []
    for k in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for i in range(7):                          # similarity falls from 1 to about 0.6
            t = list(base)
            for at in rng.choice(190, i, replace=False) if i % 2 else range(0, 12 * i, 6):
                t[at] = f"x{rng.integers(0, 10**9)}"
            docs.append((100 * k + i, " ".join(t)))
    docs += [(5000, None), (5001, ""), (5002, "one two"), (5003, "One  two"), (5004, "two one"), (None, docs[0][1]), (3, docs[0][1]), (3, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id for r in p.drop_near_copies(spark, df, "").collect()), key=lambda d: (d is None, d))
    assert got == plain_near_copies(docs)
    assert p.drop_near_copies(spark, df.limit(0), "").count() == 0


def test_registered_queries():
    import __spark_entry__ as entry
    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in entry.queries()
