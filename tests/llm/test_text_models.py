"""Toxicity, language, quality: training, edge cases, held-out accuracy on the driver's tables."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import langid, quality, queries, toxicity

DATA = "/root/testdata/sf0.01"
ODD = [(1, None, None), (2, "", ""), (3, "12 34 !!", "x"), (None, "the quick thing", "x"), (4, "the quick thing", "x"), (4, "the quick thing", "x"), (5, "日本語の文", "x"), (6, "word " * 400_000, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, x, 1.5, "s") for k, t, x in ODD], "doc_id long, text string, lang string, score double, source string").repartition(3)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_misspellings_share_subwords():
    clean = [f"the house near the river number {i} was quiet and green" for i in range(60)]
    bad = [f"the house {w} near number {i} river" for i in range(15) for w in ("idiotic", "stupidity", "worthless", "pathetic")]
    model = toxicity.train(clean + bad, np.array([0] * 60 + [1] * 60))
    z = model.logits(pa.array(["what an idiotik", "st0pidity", "a pathettic river", "the green river", "", None, "near 555-0134 house"]))
    assert (z[:3] > 0).all() and (z[3:] < 0).all()


def test_toxicity_long_text_counts_as_a_whole():
    model = toxicity.train(["good day"] * 9 + ["bad idiot"] * 9, np.array([0] * 9 + [1] * 9))
    long = "good day " * 300_000
    assert model.logits(pa.array([long, long + " idiot"])).tolist() == pytest.approx([model.logits(pa.array(["good day"]))[0], model.logits(pa.array(["idiot"]))[0]])


def test_toxicity_against_single_words():
    """Word by word with Python sums: the vectorised scores of whole texts equal them."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), -0.25)
    texts = ["One two-three", "  a  ", "", None, "Über 4you f00l!! naïve", "日本語 の text", "x" * 5000 + " tail", "same same same"]

    def plain(text):
        best = None
        for word in toxicity.normal(np.frombuffer((text or "").lower().encode(), np.uint8)).tobytes().split():
            buffer = np.frombuffer(b" " + word + b" ", np.uint8)
            weights = []
            for n in toxicity.SIZES:
                bucket, good = toxicity.ngrams(buffer, n, toxicity.BITS)
                weights += [float(model.weights[b]) for b, g in zip(bucket, good) if g]
            mean = sum(weights) / len(weights) if weights else 0.0
            best = mean if best is None else max(best, mean)
        return (best or 0.0) + model.bias

    assert model.logits(pa.array(texts)) == pytest.approx([plain(t) for t in texts], abs=1e-5)


def test_quality_scorer_against_single_texts():
    rng = np.random.default_rng(5)
    scorer = quality.Scorer(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.5)
    texts = ["One two", "", None, "a", "naïve 日本", "z" * 3000]

    def plain(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        buckets = quality._grams(raw, np.array([0, len(raw)]))[0].tolist()
        return sum(float(scorer.weights[b]) for b in buckets) / max(1, len(buckets)) + scorer.bias

    assert scorer.logits(pa.array(texts)) == pytest.approx([plain(t) for t in texts], abs=1e-5)


def test_toxicity_edge_cases(spark, odd):
    labels = spark.createDataFrame([(1, 1, 9), (3, 0, 9), (4, 1, 9), (4, 0, 9), (None, 1, 9), (7, None, 9)], "doc_id long, toxic int, text int")
    out = toxicity.score_documents(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert {r["doc_id"]: r["held_out"] for r in out} == {k: k is not None and zlib.crc32(str(k).encode()) % 5 == 0 for k, _, _ in ODD}
    assert toxicity.score_documents(odd.limit(0), labels).count() == 0
    assert [r["score"] for r in toxicity.score_documents(odd, labels.limit(0)).collect()] == pytest.approx([0.001] * len(ODD))
    with pytest.raises(ValueError):
        toxicity.score(odd, toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), 0.0))


def test_toxicity_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, DATA).collect()}
    labels = [r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    y = np.array([r["toxic"] for r in labels])
    s = np.array([got[r["doc_id"]]["score"] for r in labels])
    assert auc(s, y) > 0.95


def test_language_edge_cases(spark, odd):
    out = langid.predict_documents(odd).collect()
    assert len(out) == len(ODD)
    by = {(r["doc_id"]): r for r in out}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == "und" and by[3]["score"] == 0
    assert by[5]["lang_pred"] in ("", "x") and by[4]["lang_pred"] == "x"
    assert {r["lang_pred"] for r in langid.predict_documents(odd.withColumn("lang", odd["lang"].substr(9, 1)).na.replace("", None, "lang")).collect()} == {"und"}
    assert langid.predict_documents(odd.limit(0)).count() == 0


def exact_model(texts, langs):
    """The n-grams of each language as sets: what the filter stands for."""
    sets = {}
    for x in sorted(set(langs)):
        grams = {}
        own = [t for t, l in zip(texts, langs) if l == x]
        for t in own:
            raw = np.frombuffer(t.lower().encode(), np.uint8)
            for h in np.unique(np.concatenate([h for h, _ in langid._hashes(raw, np.array([0, len(raw)]))])).tolist():
                grams[h] = grams.get(h, 0) + 1
        sets[x] = {h for h, n in grams.items() if n >= max(min(2, len(own)), langid.MIN_SHARE * len(own))}
    return sets


def test_language_filter_against_sets():
    """Shares of n-grams in exact sets per language: the filter's corrected popcounts are near them, and decide alike."""
    words = {"aa": ["alpha", "beta", "gamma", "delta"], "bb": ["uno", "due", "tre", "beta"], "cc": ["eins", "zwei", "drei", "deltas"]}
    rng = np.random.default_rng(0)
    make = lambda x, n: " ".join(rng.choice(words[x], n))
    texts, langs = zip(*[(make(x, 20), x) for x in words for _ in range(30)])
    model, sets = langid.train(list(texts), list(langs)), exact_model(texts, langs)
    test = [make(x, 5) for x in words for _ in range(20)] + [make("aa", 9) + " " + make("bb", 3), make("bb", 6) + " unheard " + make("cc", 5)]
    best, score = model.predict(pa.array(test))
    for t, b, s in zip(test, best, score):
        raw = np.frombuffer(t.lower().encode(), np.uint8)
        grams = np.concatenate([h for h, _ in langid._hashes(raw, np.array([0, len(raw)]))]).tolist()
        shares = {x: np.mean([h in own for h in grams]) for x, own in sets.items()}
        assert shares[model.languages[b]] == max(shares.values()) and s == pytest.approx(max(shares.values()), abs=0.01)
    assert (model.false_rate < 0.01).all()


def test_many_languages():
    langs = [f"l{i:03}" for i in range(70)]
    rng = np.random.default_rng(1)
    word = lambda i: "".join(chr(97 + j) for j in np.random.default_rng(i).integers(0, 26, 8))
    texts = [" ".join(word(100 * i + int(j)) for j in rng.integers(0, 5, 30)) for i in range(70) for _ in range(3)]
    model = langid.train(texts, [x for x in langs for _ in range(3)])
    best, _ = model.predict(pa.array(texts))
    assert len(model.planes) == 2 and [model.languages[b] for b in best] == [x for x in langs for _ in range(3)]


def test_language_held_out(spark):
    out = queries.op5_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.95


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20000) < 0.8
    v = np.zeros((20000, len(quality.LABELLERS)), np.int64)
    for j in range(v.shape[1]):
        right = rng.random(20000) < 0.85 + 0.02 * j
        v[:, j] = np.where(rng.random(20000) < 0.3, quality.ABSTAIN, np.where(right == good, quality.GOOD, quality.BAD))
    codes, counts = np.unique(quality.pattern_code(v), return_counts=True)
    model = quality.expectation_maximisation(codes, counts)
    assert abs(model.prior - 0.8) < 0.05
    for j, a in enumerate(model.accuracy().values()):
        assert abs(a - (0.85 + 0.02 * j)) < 0.05
    assert ((model.posterior(quality.pattern_code(v)) > 0.5) == good).mean() > 0.95


def test_votes():
    texts = ["a | b | c | d", "LOUD!! NOISE!! HERE!!", "same same same same same.", "A quiet line of prose. Another one follows it.", None]
    v = quality.votes(pa.array(texts))
    named = [dict(zip(quality.LABELLERS, r)) for r in v.tolist()]
    assert named[0]["listing"] == named[1]["shouting"] == named[1]["exclamation"] == named[2]["repetition"] == quality.BAD
    assert named[3]["prose"] == named[3]["sentences"] == quality.GOOD
    assert (quality.pattern_votes(quality.pattern_code(v)) == v).all()


def test_quality_edge_cases(spark, odd):
    out = quality.classify(odd).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 and r["kept"] == (r["predicted"] == 1) for r in out)
    assert quality.classify(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality.score(odd, quality.fit(odd))


def test_quality_agrees_with_labels(spark):
    got = {r["doc_id"]: r for r in queries.op10_quality(spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    y = np.array([r["quality"] for r in labels])
    assert auc(np.array([got[r["doc_id"]]["posterior"] for r in labels]), y) > 0.97
    assert auc(np.array([got[r["doc_id"]]["score"] for r in labels]), y) > 0.9
    assert np.mean([got[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1]) > 0.97


def test_a_text_over_the_budget_does_not_end_the_sample(spark, monkeypatch):
    """One text larger than the whole budget, first in the order of the sample."""
    long = min(("word " * n for n in range(60, 160)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    short = [(k, f"text {k}", "x") for k in range(1, 40)]
    docs = spark.createDataFrame([(100, long, "x"), *short], "doc_id long, text string, lang string")
    taken = {t for k, t, _ in short if zlib.crc32(str(k).encode()) % 5}
    labels = spark.createDataFrame([(100, 1), *[(k, k % 2) for k, _, _ in short]], "doc_id long, toxic int")
    texts, ys = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", most_chars=299)
    assert set(texts) == taken and set(ys.tolist()) == {0, 1}
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.append(set(texts)))
    langid.fit(docs, most_chars=299)
    monkeypatch.setattr(quality, "train_scorer", lambda texts, good: seen.append(set(texts)))
    quality.fit(docs, most_chars=299)
    assert seen[0] == taken and seen[1] == {t for _, t, _ in short}


def test_other_scripts_have_sentences():
    texts = pa.array(["这 是 一 个 句 子 。 " * 5, "यह एक वाक्य है । " * 6, "plain words without any end " * 6])
    assert [r[quality.LABELLERS.index("sentences")] for r in quality.votes(texts)] == [quality.GOOD, quality.GOOD, quality.BAD]


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(docs)
