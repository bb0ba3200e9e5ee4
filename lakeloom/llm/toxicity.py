"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Every word is a bag of hashed byte n-grams (3 to 5 bytes, word ends included). The embeddings of a
bag are averaged and go through a linear softmax of two classes; embeddings and softmax are
learned together by Adam. A misspelling that was never seen shares most n-grams with the known
form, so it lands near it.

A text is as toxic as its worst word: while training, words share a text's loss by a softmax over
their logits (so evidence needn't be marked word by word); when scoring, the largest logit counts.
One insult in a long text is therefore as visible as in a short one.

As class scores are linear in the averaged embedding, a trained model scores with one number per
bucket: its embedding times the difference of the two classes' weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._common import fold, map_texts, sampled, spans, utf8
from lakeloom.llm._kernels import ngrams, spaced, word_starts

BITS, DIM, SIZES = 18, 8, (3, 4, 5)
#: Labelled texts of each class that training may use at most, and their characters in all.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 48_000_000


def _table() -> np.ndarray:
    """Lower case, look-alike digits and signs as letters, all other ASCII signs as separators."""
    t = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        t[b] = ord(c.lower()) if c.isalnum() else 0x20
    for b in b"@$":
        t[b] = b
    return t


TABLE = _table()
SAME = np.arange(256, dtype=np.uint8)
_ALIKE = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$2689", b"oieastas    "):
    _ALIKE[_a] = _b
_LOOSE = np.zeros(256, bool)
_LOOSE[list(b"0123456789@$")] = True


def normal(data: np.ndarray) -> np.ndarray:
    """Bytes of lower-case words; a look-alike counts as a letter beside a letter, else as a blank."""
    out = TABLE[data]
    loose = np.flatnonzero(_LOOSE[out])
    if len(loose):
        near = np.zeros(len(out) + 2, bool)
        near[1:-1] = ~_LOOSE[out] & (out != 0x20)
        beside = near[loose] | near[loose + 2]
        out[loose] = np.where(beside, _ALIKE[out[loose]], 0x20)
    return out


@dataclass
class Model:
    """``weights``: the logit of each bucket; ``bias`` is added to a word's mean."""

    weights: np.ndarray
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The largest word logit of each text; texts without words get the bias alone."""
        data, offsets = utf8(pc.utf8_lower(texts))
        best = np.full(len(offsets) - 1, -np.inf)
        for lo, hi in spans(offsets):
            own, doc = self._words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if len(doc):
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                best[lo + doc[first]] = np.maximum.reduceat(own, first)
        return np.where(np.isinf(best), 0.0, best) + self.bias

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, begin = spaced(normal(data), offsets, SAME)
        total, count = np.zeros(len(text), np.float32), np.zeros(len(text), np.float32)
        for n in SIZES:
            bucket, good = ngrams(text, n, BITS)
            total[1 : 1 + len(bucket)] += np.where(good, self.weights[bucket], 0)
            count[1 : 1 + len(bucket)] += good
        start = word_starts(text)
        if not len(start):
            return np.zeros(0), np.zeros(0, np.int64)
        mean = np.add.reduceat(total, start) / np.maximum(1, np.add.reduceat(count, start))
        return mean, np.searchsorted(begin, start, "right") - 1


def _summed(index: np.ndarray, weights: np.ndarray, by: np.ndarray, size: int, step: int = 1 << 20) -> np.ndarray:
    """Sums of weights[by] per index, a million at a time."""
    out = np.zeros(size)
    for at in range(0, len(index), step):
        out += np.bincount(index[at : at + step], weights[by[at : at + step]], size)
    return out


def train(texts: list[str], labels: np.ndarray, epochs: int = 60, rate: float = 0.08, decay: float = 0.1, sharpness: float = 1.0, seed: int = 7) -> Model:
    """Fit embeddings and softmax to labelled texts; without both classes, the prior alone."""
    y = np.asarray(labels, np.float64)
    prior = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    seen: dict[bytes, int] = {}
    doc_word: list[np.ndarray] = []
    for t in texts:
        low = (t or "").lower().encode()
        words = set(normal(np.frombuffer(low, np.uint8)).tobytes().split())
        doc_word.append(np.array([seen.setdefault(w, len(seen)) for w in sorted(words)], np.int32))
    flat, count = b" ".join(seen), len(seen)
    del seen
    text, _ = spaced(np.frombuffer(flat, np.uint8), np.array([0, len(flat)]), SAME)
    start = word_starts(text)
    of_byte = np.cumsum(np.bincount(start, minlength=len(text))) - 1
    bag_word, bag_bucket = [], []
    for n in SIZES:
        bucket, good = ngrams(text, n, BITS)
        at = np.flatnonzero(good)
        bag_word.append(of_byte[at + 1].astype(np.int32))
        bag_bucket.append(bucket[at].astype(np.int32))
    word, bucket = np.concatenate(bag_word), np.concatenate(bag_bucket)
    del text, of_byte, bag_word, bag_bucket
    used = np.flatnonzero(np.bincount(bucket, minlength=1 << BITS))
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    local = place[bucket]
    size = np.maximum(1, np.bincount(word, minlength=count)).astype(np.float64)
    keep = np.array([len(d) > 0 for d in doc_word])
    members = np.concatenate([d for d in doc_word if len(d)]).astype(np.int32)
    lens = np.array([len(d) for d in doc_word if len(d)])
    begin = np.cumsum(lens) - lens
    doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    target = y[keep]
    weight = np.where(target > 0, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum())) * len(target)

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (len(used), DIM))
    soft = rng.normal(0, 0.3, (DIM, 2))
    bias = 0.0
    m, v = [np.zeros_like(emb), np.zeros_like(soft), 0.0], [np.zeros_like(emb), np.zeros_like(soft), 0.0]
    for epoch in range(1, epochs + 1):
        diff = soft[:, 1] - soft[:, 0]
        logit = _summed(word, emb @ diff, local, count) / size
        z = logit[members]
        part = z * sharpness
        part -= np.maximum.reduceat(part, begin)[doc]
        np.exp(part, out=part)
        part /= np.add.reduceat(part, begin)[doc]
        mean = np.add.reduceat(part * z, begin)
        error = (1 / (1 + np.exp(-mean - bias)) - target) * weight / len(target)
        # the derivative of a softmax-weighted mean, its weights included
        part *= 1 + sharpness * (z - mean[doc])
        per_word = np.bincount(members, error[doc] * part, count) / size
        per_bucket = _summed(local, per_word, word, len(used))
        pull = emb.T @ per_bucket
        grads = [np.outer(per_bucket, diff) + decay * emb / len(used), np.stack([-pull, pull], 1) + decay * soft, float(error.sum())]
        params = [emb, soft, bias]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**epoch)) / (np.sqrt(v[i] / (1 - 0.99**epoch)) + 1e-10)
        emb, soft, bias = params
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = emb @ (soft[:, 1] - soft[:, 0])
    return Model(weights, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``per_class`` rows of each class, by the hash of their keys.

    They have ``most_chars`` characters at most: a text that no longer fits is left out and the
    next ones are tried, so one long text costs its own place only.

    Only rows whose crc32(key) mod 5 isn't 0 take part. The ids are chosen from the label table
    alone (a bounded list, hence broadcast), then one scan fetches their texts.
    """
    ranked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(F.col(key)) != 0)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    order = [F.xxhash64("_k"), F.col("_k")]
    chosen = None
    for y in (0, 1):
        some = ranked.filter(F.col("_y") == y).dropDuplicates(["_k", "_y"]).orderBy(*order).limit(per_class)
        chosen = some if chosen is None else chosen.unionAll(some)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull()).join(F.broadcast(chosen), "_k")
    texts, ys, size = [], [], 0
    for r in sampled(rows.select("_t", "_y"), "_t", 2 * per_class).toLocalIterator():
        if size + len(r[0]) > most_chars:
            continue
        size += len(r[0])
        texts.append(r[0])
        ys.append(r[1])
    return texts, np.array(ys, np.int64)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS) -> Model:
    """Train on a bounded sample of the labelled rows that aren't held out (see `labelled_sample`)."""
    return train(*labelled_sample(docs, labels, key, text, label, per_class, most_chars))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Add ``column``, the probability of class 1 of every whole text.

    Null and empty texts get the score of a text without words. Narrow: nothing is shuffled; the
    model that goes to every task has 2**BITS floats whatever the data.
    """
    if column in docs.columns:
        raise ValueError(f"the input already has {column}")
    names = docs.columns
    schema = docs.select("*", F.lit(0.0).alias(column)).schema
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            z = m.logits(batch.column(batch.schema.get_field_index(text)))
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*names, column])

    return map_texts(docs, run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score and predicted of every row of ``docs``.

    Repeated rows stay, a null key counts as not held out, null text as empty; without labels of
    both classes every score is the same. Other columns are never read.
    """
    model = fit(docs, labels, key, text)
    scored = score(docs.select(key, text), model, text).drop(text)
    return scored.select(key, (fold(F.col(key)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
