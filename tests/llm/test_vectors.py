"""Whitening and hard negatives against brute force over whole tables, their parts on their own, and awkward rows."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest


def table(spark, x, labels=None):
    rows = [(int(i), [float(c) for c in v], None if labels is None else int(labels[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)


@pytest.mark.parametrize("d,m,rank", [(1, 1, 1), (6, 3, 6), (24, 5, 24), (24, 4, 7)])
def test_rank_one_updates(d, m, rank):
    from waveloom.llm.whitening import Spectra

    rng = np.random.default_rng(d)
    x = rng.normal(size=(211, rank)) @ rng.normal(size=(rank, d)) + 1000
    x[40:60] = x[3]  # equal vectors, and later ones that touch no new direction
    s = Spectra.empty(m, d)
    for lo in range(0, len(x), m):
        s.add(x[lo : lo + m])
    one = s.combined()
    y = x - x.mean(0)
    q, size = one.q[0], np.linalg.eigvalsh(y.T @ y).max()
    assert one.n[0] == len(x) and np.allclose(one.mean[0], x.mean(0))
    assert np.abs(q.T @ q - np.eye(d)).max() < 1e-12 and np.abs((q * one.d[0]) @ q.T - y.T @ y).max() < 1e-12 * size


def brute(x):
    x = np.floor(1024 * np.asarray(x, float)).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, ((n * x - s) ** 2).sum(1), y, values[::-1], vectors[:, ::-1]


def check(got, x, c=8):
    n, dev, y, values, vectors = brute(x)
    by = defaultdict(dict)
    for r in got:
        by[r["vec_id"]][r["component"]] = r
    assert set(by) == set(range(len(x))) and all(set(v) == set(range(1, min(c, len(values)) + 1)) for v in by.values())
    w = np.array([[by[i][k]["whitened"] for k in sorted(by[i])] for i in range(len(x))])
    want = (y @ vectors[:, : w.shape[1]]) / np.sqrt(values[: w.shape[1]])
    assert np.abs(w - want * np.sign((w * want).sum(0))).max() < 1e-7
    assert all(r["n"] == n and r["deviation"] == dev[r["vec_id"]] for r in got)
    assert np.allclose([by[0][k + 1]["explained"] for k in range(w.shape[1])], values[: w.shape[1]] / values.sum(), rtol=1e-9)
    error = np.abs(w.T @ w / n - np.eye(w.shape[1])).max()
    assert all(r["identity_error"] < 1e-9 for r in got) and error < 1e-9


def test_whitening(spark):
    from waveloom.llm.whitening import whitened

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 40)) * np.linspace(0.05, 0.4, 40) + 3
    check(whitened(table(spark, x)).collect(), x)
    check(whitened(table(spark, x[:, :3])).collect(), x[:, :3])


def test_whitening_over_the_given_table(spark):
    from waveloom.llm import queries

    dir = "/root/testdata/sf0.001"
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{dir}/embeddings.parquet").orderBy("vec_id").collect()])
    check(queries.QUERIES["op11_whitening"](spark, dir).collect(), x)


def test_whitening_of_awkward_rows(spark):
    from waveloom.llm.whitening import whitened

    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0]), (1, [3.0, 5.0]), (1, [3.0, 5.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0]), (8, [0.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as component", "'a' as `x.y`", "3 as Embedding2")
    got = whitened(docs).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({None: 2, 1: 4, 8: 2}) and {r["n"] for r in got} == {4}
    assert whitened(docs.limit(0)).count() == 0 and whitened(docs.where("vec_id in (2, 6)")).count() == 0
    flat = whitened(docs.where("vec_id = 1")).collect()  # nothing varies
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in flat} == {(2, 0, None, None, None)}
    line = whitened(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and all(r["identity_error"] < 1e-9 for r in line)
    huge = whitened(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and all((r["deviation"] is None) == (r["vec_id"] < 3) for r in huge)


def mined(rows, every=50):
    """Brute force over (id, label, whole vector)."""
    out = []
    for k, (a, la, x) in enumerate(rows):
        if a % every:
            continue
        scores = [(-int(sum(p * q for p, q in zip(x, y))), i, lb) for m, (i, lb, y) in enumerate(rows) if m != k]
        for ps, p, _ in sorted(s for s in scores if s[2] == la)[:5]:
            near = sorted(s for s in scores if s[2] != la and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:3]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate(near)]
    return Counter(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("d", [3, 20, 64])
def test_hard_negatives(spark, d, monkeypatch):
    from waveloom.llm import negatives

    rng = np.random.default_rng(d)
    x = rng.normal(size=(700, d)) / np.sqrt(d) + (rng.normal(size=(9, d)) / np.sqrt(d))[rng.integers(0, 9, 700)]
    x[100:140] = x[7]  # ties
    labels = np.where(rng.random(700) < 0.4, 1, rng.integers(0, 5, 700))
    rows = [(i, int(labels[i]), np.floor(256 * x[i]).astype(int).tolist()) for i in range(700)]
    want = mined(rows, every=10)
    got = negatives.hard_negatives(table(spark, x, labels), every=10)
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == want and sum(want.values()) > 300
    monkeypatch.setattr(negatives, "CHUNK", 9)
    monkeypatch.setattr(negatives, "TILE", 4)
    assert Counter(tuple(r) for r in negatives.hard_negatives(table(spark, x, labels), every=10).select(*COLUMNS).collect()) == want


def test_bounds_hold_and_rule_out(spark):
    from waveloom.llm.negatives import LEVELS, basis, summaries

    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 70))))
    turn = basis(x[:100])
    assert np.abs(turn @ turn.T - np.eye(len(turn))).max() < 1e-9
    s, score, first, widths = summaries(x, turn).astype(float), x @ x.T, 0, []
    for n in LEVELS:
        m, v = s[:, first : first + n], s[:, first + n : first + 2 * n]
        first += 2 * n
        assert (np.abs(score - m @ m.T) <= v @ v.T + 1e-5 * np.outer(s[:, -1], s[:, -1]) + 1).all()
        widths.append((v @ v.T).mean() / np.outer(s[:, -1], s[:, -1]).mean())
    assert widths[1] < 0.05 and widths[1] < widths[0]


def test_hard_negatives_query_equals_sql_and_awkward_rows(spark):
    from waveloom.llm import queries
    from waveloom.llm.negatives import hard_negatives

    dir = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{dir}/embeddings.parquet'")
    want = duck.execute(queries.SQL["op12_negatives"])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES["op12_negatives"](spark, dir)
    assert sorted(got.columns) == sorted(columns) == sorted(COLUMNS)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall())
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.7, 0.5], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 2), (6, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (7, [1.0], 1), (8, [], 2), (9, [1e300, 1.0], 2), (50, [-1.0, 0.0], 3)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as at", "2 as rank", "3 as score", "'a' as `x.y`", "4 as Label2")
    found = [tuple(r) for r in hard_negatives(docs).select(*COLUMNS).collect()]
    # both rows 0 are anchors, each is a positive of the other, and 2 is the one negative
    assert Counter(found) == Counter([(0, 0, 1, 2, 65536, 179 * 256), (0, 1, 1, 2, 65536, 179 * 256)] * 2)
    assert hard_negatives(docs.limit(0)).count() == 0 and hard_negatives(docs.where("vec_id = 2")).count() == 0
