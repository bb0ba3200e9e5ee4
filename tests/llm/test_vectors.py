"""Vector searches against brute force."""

import numpy as np
import pytest

from lakeloom.llm import _vectors, ann, exact_topk, queries

DATA = "/root/testdata/sf0.01"


def brute(rows, every, k, prepare, nonzero=False):
    """rows: distinct (id, vector) of finite values."""
    out = []
    for q, v in rows:
        if q % every:
            continue
        scored = [(prepare(np.array(v, np.float64)) @ prepare(np.array(w, np.float64)), i) for i, w in rows if i != q and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, score int, id double").repartition(3)


@pytest.fixture
def small_shards(monkeypatch):
    """Many regions, regions that are split, groups of boxes and blocks of queries."""
    monkeypatch.setattr(_vectors, "SHARD_VALUES", 400)
    monkeypatch.setattr(_vectors, "SHARD_ROWS", 20)
    monkeypatch.setattr(_vectors, "REGION_ROWS", 8)
    monkeypatch.setattr(_vectors, "SAMPLE_VALUES", 2000)
    monkeypatch.setattr(_vectors, "BOX_GROUP", 3)
    monkeypatch.setattr(_vectors, "ROUTED", 20)


def random_rows(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=d).astype(np.float32).tolist()) for i in range(n)]


def test_exact_over_many_shards(spark, small_shards):
    rows = random_rows(300, 8)
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    got = sorted(map(tuple, exact_topk.top_k(table(spark, rows), 5, 10).collect()))
    assert got == brute(rows, 10, 5, exact_topk.quantise)


def test_exact_edge_cases(spark):
    bad = [(0, [1.0, 2.0]), (50, None), (100, [float("nan"), 1.0]), (150, [1.0, float("inf")]), (200, [None, 1.0]), (None, [1.0, 1.0]), (250, [1.0, 2.0, 3.0]), (1, [0.0, 0.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (300, [])]
    got = sorted(map(tuple, exact_topk.top_k(table(spark, bad)).collect()))
    assert got == [(0, 1, 2, 256 * 256 + 512 * 512), (0, 2, 1, 0)]
    assert exact_topk.top_k(table(spark, bad).limit(0)).count() == 0


def test_exact_huge_values(spark):
    rows = [(0, [3e15, 1.0]), (1, [2e15, 5.0]), (2, [2e15, 7.0])]
    got = {r["vec_id"]: r["score"] for r in exact_topk.top_k(table(spark, rows)).collect()}
    assert got == {1: (1 << 63) - 1, 2: (1 << 63) - 1}
    rows = [(0, [1e6, 1.0]), (1, [2e6, 5.0]), (2, [2e6, 7.0])]
    assert sorted(map(tuple, exact_topk.top_k(table(spark, rows)).collect())) == [(0, 1, 2, 256000000 * 512000000 + 256 * 1792), (0, 2, 1, 256000000 * 512000000 + 256 * 1280)]


def test_tree_boxes_are_tight():
    points = np.random.default_rng(3).normal(size=(1000, 4))
    t = _vectors.Tree(points, 16)
    assert sorted(t.order) == list(range(1000))
    for (s, e, left, _), lo, hi in zip(t.nodes, t.lo, t.hi):
        own = points[t.order[s:e]]
        assert (own.min(0) == lo).all() and (own.max(0) == hi).all() and (left >= 0 or e - s <= 16)


def test_router_parts_evenly_and_never_equal_points():
    points = np.random.default_rng(4).normal(size=(2000, 5))
    r = _vectors.Router(points, 13)
    assert r.regions == 13 and np.bincount(r.assign(points)).min() > 100
    points[:1500] = points[0]
    r = _vectors.Router(points, 13)
    at = r.assign(points)
    assert len(set(at[:1500])) == 1 and at.max() < r.regions
    assert _vectors.Router(np.zeros((10, 3)), 4).regions == 1 and _vectors.Router(np.zeros((0, 3)), 4).regions == 1


def clusters(n, d, groups, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    x = centres[rng.integers(0, groups, n)] + 0.1 * rng.normal(size=(n, d))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]


def test_exact_prunes_groups(spark, small_shards):
    rows = clusters(1200, 16, 12)
    t = table(spark, rows)
    got = sorted(map(tuple, exact_topk.top_k(t, 5, 10).collect()))
    assert got == brute(rows, 10, 5, exact_topk.quantise)
    seen = _vectors.verified(t, exact_topk.Quantised(), 10, 5, "vec_id", "embedding").first()
    assert seen["queries"] == 120 and seen["rows"] < 0.5 * len(rows)


def test_exact_hot_vector(spark, small_shards):
    """A third of all rows are one vector: its region is split by keys, ties go to the smallest."""
    rows = random_rows(400, 8) + [(1000 + i, [1.0] * 8) for i in range(200)]
    got = sorted(map(tuple, exact_topk.top_k(table(spark, rows), 5, 10).collect()))
    assert got == brute(rows, 10, 5, exact_topk.quantise)


def test_exact_equals_sql(spark):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    want = sorted(map(tuple, duckdb.sql(exact_topk.ORACLE_SQL).fetchall()))
    assert sorted(map(tuple, queries.op6_exact_topk(spark, DATA).collect())) == want


def recall(got, want, k):
    found, true = {}, {}
    for q, _, i, _ in got:
        found.setdefault(q, set()).add(i)
    for q, _, i, _ in want:
        true.setdefault(q, set()).add(i)
    return np.mean([len(found[q] & true[q]) / len(true[q]) for q in true])


@pytest.mark.parametrize("spread", [1.0, 20.0])
def test_ann_recall(spark, small_shards, spread):
    """Also with norms that differ widely."""
    rng = np.random.default_rng(5)
    rows = [(i, (np.array(v) * rng.uniform(1, spread)).astype(np.float32).tolist()) for i, v in random_rows(600, 16, 1)]
    got = sorted(map(tuple, ann.nearest(table(spark, rows), 20, 20).collect()))
    want = brute(rows, 20, 20, lambda x: x)
    assert recall(got, want, 20) >= 0.9
    vectors = dict(rows)
    for q, rank, i, s in got:
        assert s == pytest.approx(float(np.array(vectors[q]) @ np.array(vectors[i])), rel=1e-12)
    per = {}
    for q, rank, i, s in got:
        per.setdefault(q, []).append((rank, -s, i))
    assert all(len(v) == 20 and [x[0] for x in v] == list(range(1, 21)) and v == sorted(v) and sorted(v, key=lambda x: x[1:]) == v for v in per.values())


def test_ann_stops_early(spark):
    """The stopping test holds before all rows are verified, and nothing else has found them."""
    rows = clusters(3000, 32, 15)
    t = table(spark, rows)
    got = sorted(map(tuple, ann.nearest(t, 10, 50).collect()))
    assert recall(got, brute(rows, 50, 10, lambda x: x), 10) >= 0.9
    seen = ann.verified(t, 10, 50).first()
    assert seen["queries"] == 60 and 10 <= seen["rows"] < 0.2 * len(rows)


def test_ann_stops_early_without_groups(spark):
    """Random directions: the stop saves less, but still saves."""
    rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in random_rows(3000, 24, 8)]
    t = table(spark, rows)
    got = ann.nearest(t, 5, 50).collect()
    assert recall(map(tuple, got), brute(rows, 50, 5, lambda x: x), 5) >= 0.9
    assert ann.verified(t, 5, 50).first()["rows"] < 0.8 * len(rows)


def test_ann_confidence_decides(spark):
    rows = random_rows(2000, 16, 2)
    t = table(spark, rows)
    share = [ann.verified(t, 5, 40, confidence=c).first()["rows"] / len(rows) for c in (0.2, 0.99)]
    assert share[0] < 0.5 * share[1]


def test_ann_ties(spark):
    """Equal vectors tie exactly wherever they lie, and the smaller key comes first."""
    rows = random_rows(700, 24, 9)
    rows += [(2000 + i, rows[20][1]) for i in range(30)]
    got = [r for r in ann.nearest(table(spark, rows), 20, 20).collect() if r["query_id"] == 20]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(2000, 2020))


def test_ann_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0, 1.0]), (3, [2.0, 1.0]), (20, None), (40, [float("nan"), 0.0]), (60, [0.0, 0.0]), (4, [-1.0, 0.0])]
    got = sorted(map(tuple, ann.nearest(table(spark, rows)).collect()))
    assert got == [(0, 1, 2, 2.0), (0, 2, 3, 2.0), (0, 3, 4, -1.0)]
    assert ann.nearest(table(spark, rows).limit(0)).count() == 0


def test_ann_on_the_table(spark):
    got = sorted(map(tuple, queries.op8_nearest(spark, DATA).collect()))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = brute(rows, 20, 20, lambda x: x)
    assert len(got) == len(want) and recall(got, want, 20) >= 0.9


def test_chi_square():
    assert ann.chi_square(2 * np.log(2), 2) == pytest.approx(0.5)
    assert ann.chi_square_at(0.95, 12) == pytest.approx(21.026, abs=1e-3)
    with pytest.raises(ValueError):
        ann.chi_square_at(0.9, 13)
