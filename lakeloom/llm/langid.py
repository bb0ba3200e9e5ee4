"""Language ID with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit per language in every cell: looking up an n-gram reads
HASHES cells, and their AND has the bits of all languages that contain the n-gram. A text's
n-grams give one popcount per language; each is corrected for the share of false positives that
the filling of that language's slice lets expect, and the largest decides.

N-grams are of 4 and 5 bytes of lower-case words, word ends included. A language contains those
that occur in at least MIN_SHARE of its sampled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._common import fold, map_texts, sampled, spans, utf8
from lakeloom.llm._kernels import ngrams, spaced

CELL_BITS, HASHES, SIZES = 20, 2, (4, 5)
#: Documents sampled per language (on average) and in all, and the characters that training may hold.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_CHARS = 600, 8000, 100_000_000
#: Languages that a model may have: each has a bit in every cell and a row on the driver.
MOST_LANGUAGES = 1000
MIN_SHARE = 0.01
UNKNOWN = "und"

_LETTERS = np.arange(256, dtype=np.uint8)
for _b in range(128):
    _LETTERS[_b] = ord(chr(_b).lower()) if chr(_b).isalpha() else 0x20


def _cells(h: np.ndarray) -> list[np.ndarray]:
    return [(h * np.uint32(m)) >> np.uint32(32 - CELL_BITS) for m in (0x9E3779B1, 0x7FEB352D)]


def _hashes(data: np.ndarray, offsets: np.ndarray):
    """(hash, text) of every n-gram, one pair of arrays per length."""
    text, begin = spaced(data, offsets, _LETTERS)
    for n in SIZES:
        h, good = ngrams(text, n, 32)
        at = np.flatnonzero(good)
        yield h[at] ^ np.uint32(n * 0x1F123BB5), np.searchsorted(begin, at + 1, "right") - 1


@dataclass
class Model:
    """``planes``: one filter per 64 languages; ``false_rate``: of each language's slice."""

    languages: list[str]
    prior: int
    planes: list[np.ndarray]
    false_rate: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index into languages or -1, score) of each text."""
        n, k = len(texts), len(self.languages)
        data, offsets = utf8(pc.utf8_lower(texts))
        hits, total = np.zeros((n, k)), np.zeros(n)
        for lo, hi in spans(offsets):
            for h, doc in _hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                total[lo:hi] += np.bincount(doc, minlength=hi - lo)
                cells = _cells(h)
                for p, plane in enumerate(self.planes):
                    mask = plane[cells[0]]
                    for c in cells[1:]:
                        mask = mask & plane[c]
                    width = min(64, k - 64 * p)
                    if width <= 8:  # one histogram of masks per text, then its popcounts
                        masks = np.bincount(doc << width | mask, minlength=(hi - lo) << width).reshape(hi - lo, 1 << width)
                        hits[lo:hi, 64 * p : 64 * p + width] += masks @ (np.arange(1 << width)[:, None] >> np.arange(width) & 1)
                        continue
                    for b in range(width):
                        own = doc[(mask >> mask.dtype.type(b)) & mask.dtype.type(1) != 0]
                        hits[lo:hi, 64 * p + b] += np.bincount(own, minlength=hi - lo)
        rate = np.clip((hits / np.maximum(1, total)[:, None] - self.false_rate) / (1 - self.false_rate), 0, 1)
        if not k:
            return np.full(n, -1), np.zeros(n)
        best = np.where(rate.max(axis=1) > 0, rate.argmax(axis=1), self.prior)
        score = rate[np.arange(n), best]
        for i in np.flatnonzero(~_any_ascii_letter(data, offsets)):
            if not any(c.isalpha() for c in texts[int(i)].as_py() or ""):
                best[i], score[i] = -1, 0.0
        return best, score


def _any_ascii_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = np.append((data >= 0x61) & (data <= 0x7A), False)
    found = np.logical_or.reduceat(letter, offsets[:-1]) if len(offsets) > 1 else np.zeros(0, bool)
    return found & (offsets[1:] > offsets[:-1])


def train(texts: list[str], langs: list[str]) -> Model:
    """Fill the filter from texts of known languages."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], 0, [], np.zeros(0))
    sizes = np.array([langs.count(x) for x in languages])
    planes, filled = [], []
    for lo in range(0, len(languages), 64):
        group = languages[lo : lo + 64]
        kind = next(t for t, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(group) <= most)
        plane = np.zeros(1 << CELL_BITS, kind)
        for b, lang in enumerate(group):
            each = []
            for t, x in zip(texts, langs):
                if x == lang and t:
                    raw = np.frombuffer(t.lower().encode(), np.uint8)
                    each.append(np.unique(np.concatenate([h for h, _ in _hashes(raw, np.array([0, len(raw)]))])))
            grams, docs = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint32), np.zeros(0))
            for c in _cells(grams[docs >= max(min(2, len(each)), MIN_SHARE * len(each))]):
                plane[c] |= kind(1 << b)
            filled.append(np.count_nonzero(plane & kind(1 << b)) / len(plane))
        planes.append(plane)
    return Model(languages, int(sizes.argmax()), planes, np.array(filled) ** HASHES)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS) -> Model:
    """Train on about ``per_language`` documents of each language, chosen by the hash of key and text.

    Only rows with a language and crc32(key) mod 5 other than 0 take part. The sample has
    ``most_chars`` characters at most: a text that no longer fits is left out and the next ones are
    tried. More than MOST_LANGUAGES languages are refused.
    """
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(lang).alias("_l")).filter(F.col("_l").isNotNull() & F.col("_t").isNotNull() & (fold(F.col("_k")) != 0))
    sizes = rows.groupBy("_l").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    wanted = min(per_language, max(1, SAMPLE_TOTAL // max(1, len(sizes))))
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("_l") == r[0], min(1.0, wanted / r[1])).otherwise(share)
    draw = F.pmod(F.xxhash64("_k", F.length("_t")), F.lit(1 << 30)) / float(1 << 30)
    texts, langs, held = [], [], 0
    for r in sampled(rows.filter(draw < share).select("_t", "_l"), "_t", 2 * wanted * max(1, len(sizes))).toLocalIterator():
        if held + len(r[0]) > most_chars:
            continue
        held += len(r[0])
        texts.append(r[0])
        langs.append(r[1])
    return train(texts, langs)


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the language of every whole text and the corrected share of its n-grams known there.

    ``und`` with score 0 for texts that are null or have no letter; a text none of whose n-grams is
    known gets the commonest language with score 0; equal shares go to the first by code point.
    Narrow; every task gets the filter, 2**CELL_BITS cells per 64 languages.
    """
    clash = {lang, score} & set(docs.columns)
    if clash:
        raise ValueError(f"the input already has {sorted(clash)}")
    names = docs.columns
    schema = docs.select("*", F.lit("").cast("string").alias(lang), F.lit(0.0).alias(score)).schema
    for name in (lang, score):
        schema[name].nullable = True
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.planes, model.false_rate))

    def run(batches):
        m = Model(*shared.value)
        labels = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            best, value = m.predict(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels[best], pa.string()), pa.array(value)], [*names, lang, score])

    return map_texts(docs, run, schema)


def predict_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, held_out, lang_pred and score of every row of ``docs``, learned from its other folds.

    Repeated rows stay; a null key is not held out; without any known language all is ``und``.
    """
    out = predict(docs.select(key, text), fit(docs, key, text, lang), text).drop(text)
    return out.select(key, (fold(F.col(key)) == 0).alias("held_out"), "lang_pred", "score")
