"""The medoid search of the vector operator against all products, on groups of many sizes."""

import duckdb
import numpy as np
import pytest

from flowpanel.llm import vector_dup


def groups(r, dims, k, m, spread):
    """k groups of m near copies, in mixed order."""
    centres = r.normal(size=(k, dims))
    x = np.concatenate([c + r.normal(size=(m, dims)) * spread * np.linalg.norm(c) / np.sqrt(dims) for c in centres])
    return x[r.permutation(len(x))]


def graph(units):
    n, near = len(units), vector_dup.prune(units)
    return vector_dup.both_ways(n, np.repeat(np.arange(n), (near >= 0).sum(axis=1)), near[near >= 0], vector_dup.WIDE)


@pytest.mark.parametrize(("dims", "k", "m", "spread"), [(16, 60, 50, 0.08), (64, 40, 60, 0.1), (64, 6, 500, 0.1), (64, 300, 8, 0.1), (32, 900, 2, 0.1)])
def test_recall_from_medoids(dims, k, m, spread):
    units = vector_dup._unit(groups(np.random.default_rng(k), dims, k, m, spread))
    pairs = {(a, b) for q, h in vector_dup.find(units, graph(units)) for a, b in zip(q.tolist(), h.tolist())}
    truth = set(zip(*(x.tolist() for x in vector_dup.every_link(units, np.arange(len(units))))))
    assert len(truth) >= k * m / 2 and pairs <= truth and len(pairs) >= 0.99 * len(truth)


def test_the_search_from_medoids_decides(monkeypatch):
    """Without medoids that lead to a part of the graph, its links are not found."""
    r = np.random.default_rng(2)
    units = vector_dup._unit(np.concatenate([groups(r, 16, 4, 30, 0.05), -groups(np.random.default_rng(9), 16, 4, 30, 0.05)]))
    lists = graph(units)
    cut = [x[(x < 120) == (k < 120)] for k, x in enumerate(lists)]  # two parts that do not touch
    whole = sum(len(q) for q, _ in vector_dup.find(units, lists))
    assert whole == len(vector_dup.every_link(units, np.arange(240))[0])
    monkeypatch.setattr(vector_dup, "MEDOIDS", 1)
    assert 0 < sum(len(q) for q, _ in vector_dup.find(units, cut)) < 0.6 * whole


def test_lists_are_bounded_and_both_ways():
    """One vector that all others name keeps its own list and a bounded part of theirs."""
    n = 500
    tail, head = np.concatenate([np.arange(1, n), np.arange(1, n), [0, 0]]), np.concatenate([np.zeros(n - 1, np.int64), np.arange(1, n) % (n - 1) + 1, [7, 9]])
    lists = vector_dup.both_ways(n, tail, head, 40)
    assert len(lists[0]) == 40 and {7, 9} <= set(lists[0].tolist()) and max(map(len, lists)) <= 40
    assert all(0 in lists[k] and k in lists[k % (n - 1) + 1] for k in range(1, n))


def test_a_group_larger_than_its_lists_beside_sql(spark, tmp_path):
    """Real links: groups of 2 to 150 near copies in two labels, beside the SQL."""
    from flowpanel.llm.queries import ORACLE_SQL

    r = np.random.default_rng(4)
    x = np.concatenate([groups(r, 24, 1, 150, 0.08), groups(r, 24, 3, 60, 0.08), groups(r, 24, 40, 2, 0.08), r.normal(size=(120, 24))])
    rows = [(i, [float(np.float32(v)) for v in e], i % 2) for i, e in enumerate(x[r.permutation(len(x))])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op1_embedding_near_dup"]).fetchall()
    got = [(q["vec_id"], q["n_links"], q["component_id"], q["kept"]) for q in vector_dup.op1_embedding_near_dup(spark, str(tmp_path)).collect()]
    assert max(w[1] for w in want) > vector_dup.CANDIDATES and sorted(got) == sorted(want)


def test_a_poor_search_is_made_again_wider(spark, monkeypatch):
    df = spark.createDataFrame([(i, [1.0, i / 1000], 0) for i in range(60)], "vec_id long, embedding array<double>, label int")
    beams, search = [], vector_dup.search
    monkeypatch.setattr(vector_dup, "search", lambda v, shard, beam: beams.append(beam) or search(v, shard, beam))
    monkeypatch.setattr(vector_dup, "recall", lambda found: (100, 89 + len(beams)))
    assert vector_dup.near_vectors(df).count() == 60 and beams == [vector_dup.BEAM]
    beams.clear()
    monkeypatch.setattr(vector_dup, "recall", lambda found: (100, 87 + len(beams)))
    vector_dup.near_vectors(df)
    assert beams == [vector_dup.BEAM, 4 * vector_dup.BEAM, 16 * vector_dup.BEAM]
