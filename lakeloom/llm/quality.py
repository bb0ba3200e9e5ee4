"""Quality classifier from weak labels.

Heuristic labellers look at one trait of a whole text each and vote good, bad or abstain.
Expectation-maximisation over the counts of vote patterns (all documents, at most 3**labellers
rows) estimates how each labeller votes on good and on bad texts, hence its accuracy, without any
gold label. The patterns' posteriors then label the texts that train a hashed linear scorer over
byte trigrams, which scores every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._common import CHUNK_BYTES, map_texts, sampled, spans, utf8
from lakeloom.llm._kernels import ngrams, spaced, word_starts
from lakeloom.llm.bpe import slice_hashes

BITS = 15
#: Documents that train the scorer (on average), and the characters in all that training may hold.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 60_000_000
ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("listing", "shouting", "decoration", "repetition", "exclamation", "sentences", "prose")

_WHITE = np.arange(256, dtype=np.uint8)
_WHITE[[9, 10, 11, 12, 13]] = 0x20
_SAME = np.arange(256, dtype=np.uint8)


def _marks(chars: str) -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[[ord(c) for c in chars]] = 1
    return t


_COUNTED = {
    "pipe": _marks("|"),
    "upper": _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": _marks("abcdefghijklmnopqrstuvwxyz"),
    "sign": _marks("*#%&$~^=_<>"),
    "bang": _marks("!"),
    "stop": _marks(".?"),
}
#: Sentence ends of other scripts; they count as "stop".
STOPS = ("。", "．", "｡", "！", "？", "।", "॥", "؟", "۔", "።", "։", "။", "។")


def traits(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts over each whole text; null counts as empty."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    histogram = np.zeros((n, 256))
    for i in range(n):
        for at in range(offsets[i], offsets[i + 1], CHUNK_BYTES):
            histogram[i] += np.bincount(data[at : min(at + CHUNK_BYTES, offsets[i + 1])], minlength=256)
    out = {k: histogram @ t for k, t in _COUNTED.items()} | {k: np.zeros(n) for k in ("words", "repeats")}
    for lo, hi in spans(offsets):
        raw, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if not len(raw):
            continue
        text, begin = spaced(raw, off, _WHITE)
        start = word_starts(text)
        if not len(start):
            continue
        end = np.flatnonzero((text[1:] == 0x20) & (text[:-1] != 0x20)) + 1
        h = slice_hashes(text, start, end)
        doc = np.searchsorted(begin, start, "right") - 1
        out["words"][lo:hi] += np.bincount(doc, minlength=hi - lo)
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out["repeats"][lo:hi] += np.bincount(doc[1:][same], minlength=hi - lo)
    for sign in STOPS:
        if histogram[:, sign.encode()[0]].any():
            out["stop"] += pc.count_substring(texts, sign).fill_null(0).to_numpy(zero_copy_only=False)
    return out


def votes(texts: pa.Array) -> np.ndarray:
    """One column per labeller."""
    t = traits(texts)
    words = np.maximum(1, t["words"])
    letters = np.maximum(1, t["upper"] + t["lower"])

    def above(share: np.ndarray, bad: float) -> np.ndarray:
        return np.where(share >= bad, BAD, ABSTAIN)

    marks = (t["pipe"] + t["sign"] + t["bang"] + t["repeats"]) / words
    upper = np.where(letters > 8, t["upper"] / letters, 0)
    stops = t["stop"] / words
    return np.stack(
        [
            above(t["pipe"] / words, 0.08),
            above(upper, 0.3),
            above(t["sign"] / words, 0.12),
            above(t["repeats"] / words, 0.1),
            above(t["bang"] / words, 0.1),
            np.where((t["words"] >= 20) & (stops < 0.02), BAD, np.where((stops > 0.03) & (stops < 0.5), GOOD, ABSTAIN)),
            np.where((marks >= 0.1) | (upper >= 0.3), BAD, np.where((marks < 0.04) & (upper < 0.2), GOOD, ABSTAIN)),
        ],
        1,
    ).astype(np.int8)


def pattern_code(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ 3 ** np.arange(v.shape[1], dtype=np.int64)


def pattern_votes(codes: np.ndarray) -> np.ndarray:
    return np.asarray(codes, np.int64)[:, None] // 3 ** np.arange(len(LABELLERS), dtype=np.int64) % 3


@dataclass
class LabelModel:
    """``prior``: share of good texts; ``table[y, j, v]``: how often labeller j votes v on class y."""

    prior: float
    table: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """The probability of good for vote patterns."""
        v = pattern_votes(codes)
        j = np.arange(v.shape[1])
        logp = np.log(self.table[:, j, v]).sum(axis=-1) + np.log([1 - self.prior, self.prior])[:, None]
        return 1 / (1 + np.exp(np.clip(logp[0] - logp[1], -500, 500)))

    def accuracy(self) -> dict[str, float]:
        """Of each labeller where it votes."""
        p = np.array([1 - self.prior, self.prior])
        right = p[0] * self.table[0, :, BAD] + p[1] * self.table[1, :, GOOD]
        wrong = p[0] * self.table[0, :, GOOD] + p[1] * self.table[1, :, BAD]
        return dict(zip(LABELLERS, (right / (right + wrong)).tolist()))


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Fit the label model to pattern counts, from the start that one bad vote means bad."""
    v = pattern_votes(codes)
    w = np.asarray(counts, np.float64)
    good = np.where((v == BAD).any(axis=1), 0.1, 0.9)
    model = LabelModel(0.5, np.full((2, v.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        soft = np.stack([(1 - good) * w, good * w])
        prior = float(np.clip(soft[1].sum() / max(1e-9, soft.sum()), 1e-3, 1 - 1e-3))
        table = np.stack([[[p[v[:, j] == x].sum() + 0.1 for x in range(3)] for j in range(v.shape[1])] for p in soft])
        model = LabelModel(prior, table / table.sum(axis=2, keepdims=True))
        new = model.posterior(codes)
        if len(new) == 0 or np.abs(new - good).max() < 1e-7:
            break
        good = new
    return model


@dataclass
class Scorer:
    """``weights`` of hashed trigrams, applied to their mean, and ``bias``."""

    weights: np.ndarray
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        """A text of n bytes has n trigrams: those whose middle byte is one of its own."""
        data, offsets = utf8(texts)
        total, count = np.zeros(len(offsets) - 1), np.diff(offsets)
        for lo, hi in spans(offsets):
            text, begin = spaced(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], _SAME)
            bucket, _ = ngrams(text, 3, BITS)
            weights = np.append(self.weights[bucket], np.float32(0))
            ends = np.stack([begin - 1, begin - 1 + count[lo:hi]], 1).ravel()
            total[lo:hi] = np.add.reduceat(weights, np.minimum(ends, len(weights) - 1), dtype=np.float64)[::2]
        return np.where(count > 0, total, 0) / np.maximum(1, count) + self.bias


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every trigram within a text, one blank before and after it included."""
    text, begin = spaced(data, offsets, _SAME)
    bucket, _ = ngrams(text, 3, BITS)
    inside = np.ones(len(bucket), bool)
    between = begin[1:] - 2  # of a trigram whose middle byte is the blank between two texts
    inside[between[(between >= 0) & (between < len(bucket))]] = False
    at = np.flatnonzero(inside)
    return bucket[at], np.maximum(0, np.searchsorted(begin, at + 1, "right") - 1)


def train_scorer(texts: list[str], good: np.ndarray, epochs: int = 150, rate: float = 2.0, decay: float = 1e-6) -> Scorer:
    """Logistic regression on trigram shares with soft labels, by Adam over all texts at once."""
    texts = [t or "" for t in texts]
    if not texts:
        return Scorer(np.zeros(1 << BITS, np.float32), 0.0)
    cols, rows, vals = [], [], []
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        bucket, _ = _grams(raw, np.array([0, len(raw)]))
        b, c = np.unique(bucket, return_counts=True)
        cols.append(b.astype(np.int64))
        rows.append(np.full(len(b), i))
        vals.append(c / max(1, c.sum()))
    col, row, val = np.concatenate(cols), np.concatenate(rows), np.concatenate(vals)
    w, bias = np.zeros(1 << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for e in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col] * val, len(texts)) + bias, -50, 50)))
        err = (p - good) / len(texts)
        g, gb = np.bincount(col, err[row] * val, len(w)) + decay * w / len(texts), float(err.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - rate * (m / (1 - 0.9**e)) / (np.sqrt(v / (1 - 0.99**e)) + 1e-9)
        bias = bias - 0.1 * (mb / (1 - 0.9**e)) / (np.sqrt(vb / (1 - 0.99**e)) + 1e-9)
    return Scorer(w.astype(np.float32), bias)


def label_patterns(docs: DataFrame, text: str = "text", column: str = "vote_pattern") -> DataFrame:
    """Replace ``text`` by the code of its votes (narrow)."""
    base = docs.drop(text)
    names = base.columns
    schema = base.select("*", F.lit(0).cast("long").alias(column)).schema

    def run(batches):
        for batch in batches:
            codes = pattern_code(votes(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(codes)], [*names, column])

    return map_texts(docs, run, schema)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS) -> tuple[LabelModel, Scorer]:
    """Label model from the votes on all documents, scorer from about ``sample`` of them.

    The sample has ``most_chars`` characters at most: a text that no longer fits is left out and
    the next ones are tried.
    """
    patterns = label_patterns(docs.select(F.col(text).alias("text"))).groupBy("vote_pattern").count().collect()  # 3**7 rows at most
    codes, counts = np.array([r[0] for r in patterns], np.int64), np.array([r[1] for r in patterns], np.int64)
    if not len(codes):
        return LabelModel(0.5, np.full((2, len(LABELLERS), 3), 1 / 3)), train_scorer([], np.zeros(0))
    model = expectation_maximisation(codes, counts)
    share = min(1.0, sample / int(counts.sum()))
    draw = F.pmod(F.xxhash64(F.col(key), F.length(F.col(text))), F.lit(1 << 30)) / float(1 << 30)
    texts, held = [], 0
    for r in sampled(docs.filter(draw < share).select(F.coalesce(F.col(text), F.lit("")).alias("_t")), "_t", 2 * sample).toLocalIterator():
        if held + len(r[0]) > most_chars:
            continue
        held += len(r[0])
        texts.append(r[0])
    good = model.posterior(pattern_code(votes(pa.array(texts, pa.string())))) if texts else np.zeros(0)
    return model, train_scorer(texts, good)


def score(docs: DataFrame, fitted: tuple[LabelModel, Scorer], text: str = "text") -> DataFrame:
    """Add ``posterior`` (of good, by the votes) and ``score`` (of good, by the scorer) of each whole text.

    Narrow; null and empty texts are scored as texts without words. Columns of these names are refused.
    """
    clash = {"posterior", "score"} & set(docs.columns)
    if clash:
        raise ValueError(f"the input already has {sorted(clash)}")
    names = docs.columns
    schema = docs.select("*", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast((fitted[0].prior, fitted[0].table, fitted[1].weights, fitted[1].bias))

    def run(batches):
        prior, table, weights, bias = shared.value
        label, scorer = LabelModel(prior, table), Scorer(weights, bias)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            p = 1 / (1 + np.exp(-np.clip(scorer.logits(texts), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label.posterior(pattern_code(votes(texts)))), pa.array(p)], [*names, "posterior", "score"])

    return map_texts(docs, run, schema)


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, posterior, score, predicted (1: good, score >= 0.5) and kept of every row.

    Repeated rows and null keys stay. No label table is read.
    """
    out = score(docs.select(key, text), fit(docs, key, text), text).drop(text)
    return out.select(key, "posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))
