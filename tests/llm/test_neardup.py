"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import _shingles, neardup, queries
from lakeloom.llm._components import components

DATA = "/root/testdata/sf0.001"


def shingles(text, words):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < words else [tuple(w[i : i + words]) for i in range(len(w) - words + 1)])


def brute(rows, words, percent=80):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            near = sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            if near or same:
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    out = []
    for i, (k, _) in enumerate(rows):
        c = low.get(find(i)) if k is not None else None
        out.append((k, len(sets[i]), c, k is None or k == c))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1, "x", "y") for k, t in rows], "doc_id long, text string, id int, fp string, component_id string").repartition(4)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(60))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.3:
            text = rng.choice(out)
        elif out and kind < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind < 0.75:
            text = " ".join(passage + [word() for _ in range(rng.randrange(80))])
        else:
            text = " ".join(word() for _ in range(rng.randrange(1, 120)))
        out.append(text)
    return [(i * 7 % 997, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("words", [4, 5])
def test_equals_brute_force(spark, words):
    rows = corpus(words)
    assert got(neardup.near_duplicates(frame(spark, rows), words)) == brute(rows, words)


@pytest.mark.parametrize("percent", [60, 80])
def test_large_buckets_lose_no_pair(spark, monkeypatch, percent):
    """Every bucket counts as large, so all open pairs come from rare shingles."""
    monkeypatch.setattr(neardup, "SMALL", 0)
    rows = corpus(11, 150)
    assert got(neardup.near_duplicates(frame(spark, rows), 2, percent)) == brute(rows, 2, percent)


def test_one_id_with_several_texts(spark):
    """Its texts are one document, and links of either text count."""
    words = lambda tag, n=40: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(7, words("a")), (7, words("b")), (3, words("a")), (9, words("b") + " more"), (12, words("a") + " more"), (20, words("c")), (20, words("d")), (21, words("e"))]
    for order in (rows, rows[::-1]):
        assert got(neardup.near_duplicates(frame(spark, order), 4)) == brute(rows, 4)


def test_templates_stay_linear(spark):
    """Texts that share three quarters of a template: many in a bucket, none near, few pairs to confirm."""
    rng = random.Random(3)
    template = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(template + [f"u{i}x{rng.randrange(10**6)}" for _ in range(90)])) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(5)]
    df = frame(spark, rows)
    words = 2
    base = neardup.signatures(df, words)
    members = base.select("id", F.col("n_shingles").alias("n"), F.explode("keys").alias("bucket"))
    multi = members.join(members.groupBy("bucket").count().filter("count > 1"), "bucket").cache()
    assert multi.groupBy("bucket").count().agg(F.max("count")).first()[0] > 200
    sets = neardup.sets_of(df, base.select("id"), words).cache()
    none = spark.createDataFrame([], "id long, component long")
    pairs = {tuple(r) for r in neardup.open_pairs(multi, none, sets, 80).collect()}
    assert {(i, 1000 + i) for i in range(5)} <= pairs
    assert len(pairs) < 16 * len(rows)
    assert got(neardup.near_duplicates(df, words)) == sorted([(i, n, i - 1000 if i >= 1000 else i, i < 1000) for i, n in base.select("id", "n_shingles").collect()], key=repr)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\ttwo"), (6, "one two three"), (None, "one two"), (7, "x"), (7, "x"), (8, "é É"), (9, "É É"), (10, "w " * 50_000), (11, "w " * 50_001), (12, " ".join(map(str, range(60_000)))), (13, " ".join(map(str, range(1, 60_000))))]
    assert got(neardup.near_duplicates(frame(spark, rows), 4)) == brute(rows, 4)
    assert neardup.near_duplicates(frame(spark, rows).limit(0), 4).count() == 0
    assert got(neardup.near_duplicates(frame(spark, [(1, None), (2, "")]), 4)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_chain_and_hot_group(spark):
    """A chain in which only neighbours are near, and many copies and near copies of one text."""
    base = [f"w{i}" for i in range(200)]
    chain = [(i, " ".join(base[5 * i :] + [f"v{j}" for j in range(5 * i)])) for i in range(12)]
    hot = [(100 + i, " ".join(["same"] + [f"h{j}" for j in range(150)] + [f"tail{i % 40}"])) for i in range(300)]
    rows = chain + hot
    assert got(neardup.near_duplicates(frame(spark, rows), 5)) == brute(rows, 5)


def test_deduplicate(spark):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (9, "other words here now then too"), (None, "a b c d e f"), (9, "other words here now then too"), (1, None)]
    df = frame(spark, rows)
    out = neardup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"]) for r in out.collect()), key=repr) == sorted([3, 9, 1, None], key=repr)
    many = neardup.BROADCAST_IDS
    try:
        neardup.BROADCAST_IDS = 0  # the way beyond the size check
        assert sorted((r["doc_id"] for r in neardup.deduplicate(df).collect()), key=repr) == sorted([3, 9, 1, None], key=repr)
    finally:
        neardup.BROADCAST_IDS = many


def test_null_keys_stay_beside_a_repeated_key(spark):
    rows = [(9, "other words here now then too"), (9, "other words here now then too"), (None, "one text without an id"), (None, "a second text without an id"), (None, None)]
    out = neardup.deduplicate(frame(spark, rows)).select("doc_id", "text")
    assert got(out) == sorted(rows[1:], key=repr)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 2), (2, 1), (7, 7)], "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]


def test_min_max_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000, np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, np.uint64)])
    sig = _shingles.min_max(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000, 2000]), 400)
    assert (sig[0] == sig[1]).mean() == pytest.approx(800 / 1200, abs=0.06)


def test_on_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got(queries.op9_near_duplicates(spark, DATA)) == brute(rows, 4)
