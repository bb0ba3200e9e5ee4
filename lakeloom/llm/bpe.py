"""BPE encoding and decoding with a pair occurrence index.

Texts of a partition are cut into pre-tokens; the distinct ones among them are laid out as one
array of symbols with links to both neighbours. An index maps each mergeable pair, named by its
rank, to all positions where it occurs. Active ranks are applied in ascending order (a heap): all
positions of a rank merge at once, and the new pairs on either side are added to the lists of
their ranks. Entries that a merge made stale are recognised and dropped when their rank comes up.

Cutting a text (the pattern of byte-level BPE vocabularies) is done on UTF-8 bytes with numpy, so
no Python code runs per word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm._common import CHUNK_BYTES, map_texts, spans, utf8

LETTER, NUMBER, SPACE, OTHER, SPECIAL = 1, 2, 3, 4, 5
#: Distinct pre-tokens whose ids a task keeps; beyond it the table starts anew.
TABLE_WORDS = 1_000_000
#: Text bytes whose distinct pre-tokens are merged together.
MERGE_BYTES = 1 << 21


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for code, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = code
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character; bytes of one character have the same."""
    table = classes()
    out = table[:256][data]
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        lead = high[data[high] >= 0xC0]
        first = data[lead].astype(np.uint32)
        width = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
        at = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.uint32) & 0x3F
        point = np.where(
            width == 2,
            (first & 0x1F) << 6 | at(1),
            np.where(width == 3, (first & 0x0F) << 12 | at(1) << 6 | at(2), (first & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)),
        )
        kind = table[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            some = width > k
            out[lead[some] + k] = kind[some]
    return out


def cuts(data: np.ndarray, starts: np.ndarray, special: list[bytes] = ()) -> tuple[np.ndarray, dict[int, int]]:
    """Where pre-tokens start, for texts that start at ``starts``; the special ones among them.

    ``starts`` must be ascending and within the data (no empty text).
    """
    n = len(data)
    kind = byte_classes(data)
    found: dict[int, int] = {}
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    fresh = np.zeros(n + 1, bool)  # where special strings end
    if special:
        raw = data.tobytes()
        if any(s in raw for s in special):
            import re

            edges = np.append(starts, n)
            for m in re.finditer(b"|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)), raw):
                if edges[np.searchsorted(edges, m.start(), "right")] >= m.end():
                    found[m.start()] = special.index(m.group())
                    kind[m.start() : m.end()] = SPECIAL
                    first[m.start()] = True
                    fresh[m.end()] = True
    first |= fresh
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # a word, number or sign run after white space
    e = np.flatnonzero((kind[1:] != SPACE) & (kind[1:] != SPECIAL) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
    if len(e):
        before = data[e - 1]
        start[e] = before != 0x20
        q = e - 1
        wide = before >= 0x80
        if wide.any():
            q[wide] = np.where(data[e[wide] - 2] >= 0xC0, e[wide] - 2, e[wide] - 3)
        start[q] = True
    # contractions
    a = np.flatnonzero((data == 0x27) & start[:n] & start[1:] & (kind == OTHER))
    a = a[a + 1 < n]
    a = a[(kind[a + 1] == LETTER) & ~first[a + 1]]
    if len(a):
        c1 = data[a + 1]
        has2 = (a + 2 < n) & ~first[np.minimum(a + 2, n)]
        c2 = np.where(has2, data[np.minimum(a + 2, n - 1)], 0)
        one = (c1 == ord("s")) | (c1 == ord("t")) | (c1 == ord("m")) | (c1 == ord("d"))
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for some, width in ((one, 2), (two & ~one, 3)):
            p = a[some]
            start[p + 1] = False
            start[p + width] = True
    return np.flatnonzero(start[:n]), found


@lru_cache(1)
def _hash_tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**64, (2, 256), np.uint64), np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base and of its inverse modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[base]


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each slice: a polynomial over random byte values, mixed."""
    tables, bases = _hash_tables()
    up, down = _powers(int(bases[which]), 1 << max(12, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tables[which][data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h + (ends - starts).astype(np.uint64)


def gather(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one after another."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    shift = offsets - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(total)]


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file of the tokenizers library.

    Raises ValueError for files with other settings, which this operator doesn't cover.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        added = spec.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: added tokens that strip or match single words")
        to_byte, vocab = byte_symbols(), model["vocab"]
        self.special = [t["content"].encode() for t in added]
        self.special_ids = np.array([t["id"] for t in added], np.int32)
        size = 1 + max([*vocab.values(), *self.special_ids.tolist()])
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(to_byte[c] for c in token)
        for t in added:
            pieces[t["id"]] = t["content"].encode()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.of_byte = np.zeros(256, np.int32)
        for c, b in to_byte.items():
            self.of_byte[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.size = size
        keys = self.left * size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode_words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids of each word) for words that lie one after another in ``data``."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        ends = np.cumsum(lengths)
        sym = self.of_byte[data]
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[ends - lengths] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edge = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            lo = 0
            for hi in [*edge.tolist(), len(at)]:
                r = int(rank[lo])
                own = index.get(r)
                if own is None:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(heap, r)
                else:
                    own.append(at[lo:hi])
                lo = hi

        add(np.flatnonzero(nxt >= 0))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            j = nxt[at]
            good = (sym[at] == a) & (j >= 0)
            good &= sym[j] == b
            at = at[good]
            if not len(at):
                continue
            if a == b:  # of overlapping occurrences, every second from the left
                at = np.sort(at)
                follows = np.zeros(len(at), bool)
                follows[1:] = nxt[at[:-1]] == at[1:]
                i = np.arange(len(at))
                at = at[(i - np.maximum.accumulate(np.where(follows, 0, i))) % 2 == 0]
            j = nxt[at]
            k = nxt[j]
            sym[at] = self.merged[r]
            sym[j] = -1
            nxt[at] = k
            inner = k >= 0
            prv[k[inner]] = at[inner]
            p = prv[at]
            touched = np.concatenate([p[p >= 0], at[inner]])
            if len(touched):
                add(np.unique(touched) if len(touched) > 1 else touched)
        alive = sym >= 0
        return sym[alive], np.add.reduceat(alive, ends - lengths, dtype=np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.offsets[ids], self.lengths[ids]).tobytes()


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches of texts; remembers the ids of pre-tokens seen before."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # ascending
        self.where = np.zeros(0, np.int64)  # the word of each known hash
        self.flat: list[np.ndarray] = []
        self.ids = np.zeros(0, np.int32)
        self.off = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.check = np.zeros(0, np.uint64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The word number of each pre-token; new ones are merged and added."""
        h, h2 = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # hashing takes some 30 bytes a byte, so in pieces
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + (CHUNK_BYTES >> 1))))
            s, e = int(starts[at]), int(ends[to - 1])
            for which, out in enumerate((h, h2)):
                out[at:to] = slice_hashes(data[s:e], starts[at:to] - s, ends[at:to] - s, which)
            at = to
        uniques, one, codes = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, uniques)
        inside = np.minimum(place, max(0, len(self.known) - 1))
        old = self.known[inside] == uniques if len(self.known) else np.zeros(len(uniques), bool)
        number = np.empty(len(uniques), np.int64)
        if old.any():
            number[old] = self.where[inside[old]]
        new = np.flatnonzero(~old)
        if len(new):
            s, n = starts[one[new]], (ends - starts)[one[new]]
            ids, count = self.v.encode_words(gather(data, s, n), n)
            number[new] = len(self.len) + np.arange(len(new))
            self.off = np.concatenate([self.off, len(self.ids) + np.cumsum(count) - count])
            self.len = np.concatenate([self.len, count])
            self.ids = np.concatenate([self.ids, ids])
            self.check = np.concatenate([self.check, h2[one[new]]])
            self.known = np.insert(self.known, place[new], uniques[new])
            self.where = np.insert(self.where, place[new], number[new])
        out = number[codes]
        if not np.array_equal(self.check[out], h2):
            raise ArithmeticError("two pre-tokens share a 64-bit hash")
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each text)."""
        texts = len(offsets) - 1
        filled = np.flatnonzero(np.diff(offsets))
        counts = np.zeros(texts, np.int64)
        if not len(filled):
            return np.zeros(0, np.int32), counts
        if len(self.len) > TABLE_WORDS:
            self.clear()
        begin = offsets[filled]
        starts, special = cuts(data, begin, self.v.special)
        ends = np.append(starts[1:], len(data))
        try:
            word = self.words(data, starts, ends)
        except ArithmeticError:  # practically never: without the shared table, word by word
            self.clear()
            parts = [self.v.encode_words(data[s:e], np.array([e - s]))[0] for s, e in zip(starts, ends)]
            lens = np.array([len(p) for p in parts])
            ids = np.concatenate(parts)
        else:
            lens = self.len[word]
            ids = gather(self.ids, self.off[word], lens)
        if special:
            first = np.cumsum(lens) - lens
            drop = np.ones(len(ids), bool)
            for at, which in special.items():
                t = int(np.searchsorted(starts, at))
                ids[first[t]] = self.v.special_ids[which]
                drop[first[t] + 1 : first[t] + lens[t]] = False
                lens[t] = 1
            ids = ids[drop]
        bounds = np.searchsorted(starts, np.append(begin, len(data)))
        total = np.concatenate([[0], np.cumsum(lens)])
        counts[filled] = np.diff(total[bounds])
        return ids, counts


def _pieces(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first text, last text, bytes, offsets, whether they end there): ranges of texts, or parts of a long one.

    A long text is cut before a blank that follows neither white space nor a byte above 127; a
    pre-token starts there in any case.
    """
    for lo, hi in spans(offsets, limit):
        s, e = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or e - s <= 2 * limit:
            yield lo, hi, data[s:e], offsets[lo : hi + 1] - s, True
            continue
        while s < e:
            t = min(e, s + limit)
            if t < e:
                part = data[t - 1 : min(e, t + limit)]
                ok = (part[1:] == 0x20) & (part[:-1] > 0x20) & (part[:-1] < 0x7F)
                t = t + int(ok.argmax()) if ok.any() else min(e, t + limit)
                if t < e and not ok.any():  # no blank at all in so many bytes: the rest in one piece
                    t = e
            yield lo, hi, data[s:t], np.array([0, t - s]), t == e
            s = t


def encode_parts(encoder: Encoder, texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """(first text, last text, ids of each, their number), a few MB of texts at a time."""
    data, offsets = utf8(texts)
    held: list[np.ndarray] = []
    for lo, hi, part, off, done in _pieces(data, offsets, MERGE_BYTES):
        got, each = encoder.encode(part, off)
        if hi - lo == 1:  # maybe a piece of a long text
            held.append(got)
            if not done:
                continue
            ids = held[0] if len(held) == 1 else np.concatenate(held)
            held = []
            yield lo, hi, [ids], np.array([len(ids)], np.int64)
        else:
            ends = np.cumsum(each)
            yield lo, hi, [got[e - n : e] for e, n in zip(ends.tolist(), each.tolist())], each


def encode_batch(encoder: Encoder, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """(ids of each text, their number)."""
    ids, counts = [], [np.zeros(0, np.int64)]
    for _, _, some, each in encode_parts(encoder, texts):
        ids += some
        counts.append(each)
    return ids, np.concatenate(counts)


def count_batch(encoder: Encoder, texts: pa.Array) -> np.ndarray:
    """The number of ids of each text; ids aren't kept."""
    return np.concatenate([np.zeros(0, np.int64), *(each for _, _, _, each in encode_parts(encoder, texts))])


def _added(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    clash = {n for n, _ in fields} & set(df.columns)
    if clash:
        raise ValueError(f"the input already has {sorted(clash)}")
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """Add the token ids of each whole text and their number.

    ``ids`` is a binary column: unsigned 32-bit little-endian ids one after another. Equals the
    tokenizers library without added special tokens; special strings inside a text become their
    ids. Null and empty texts have no ids and count 0. Other columns pass through; a column named
    like an added one is refused. Narrow; a partition needs memory for one Arrow batch of texts.
    """
    base = df if keep_text else df.drop(text)
    schema = _added(base, [(count, T.LongType()), (ids, T.BinaryType())])
    names = base.columns

    def run(batches):
        encoder = Encoder(vocabulary(tokenizer))
        for batch in batches:
            for lo, hi, got, counts in encode_parts(encoder, batch.column(batch.schema.get_field_index(text))):
                cols = [batch.column(batch.schema.get_field_index(n)).slice(lo, hi - lo) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts), pa.array([id_bytes(x) for x in got], pa.binary())], [*names, count, ids])

    return map_texts(df, run, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "token_ids", text: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Add the text of each ``ids`` (as `encode` gives them), special tokens included.

    Bytes that aren't UTF-8 become U+FFFD, as in the library; null ids give an empty text. An id
    beyond the vocabulary raises IndexError.
    """
    base = df if keep_ids else df.drop(ids)
    schema = _added(base, [(text, T.StringType())])
    names = base.columns

    def run(batches):
        v = vocabulary(tokenizer)
        for batch in batches:
            raw, off = utf8(batch.column(batch.schema.get_field_index(ids)))
            out: list[str] = []
            for lo, hi in spans(off, 4 * CHUNK_BYTES):
                own = np.frombuffer(raw[off[lo] : off[hi]].tobytes(), "<u4").astype(np.int64)
                size = v.lengths[own]
                flat = gather(v.bytes, v.offsets[own], size).tobytes()
                total = np.concatenate([[0], np.cumsum(size)])
                ends = total[(off[lo : hi + 1] - off[lo]) // 4]
                out += [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string())], [*names, text])

    return map_texts(df, run, schema)


def id_bytes(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit little-endian."""
    return ids.astype("<u4", copy=False).tobytes()


def digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens and the digests of the ids and of the text decoded from them.

    Encoding and decoding run in one worker, chunk by chunk, so ids and decoded texts never leave
    it. Null text counts as empty; repeated rows and null keys stay.
    """
    rows = docs.select(F.col(key).alias(key), F.col(text).alias(text))
    schema = T.StructType([rows.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        v = vocabulary(tokenizer)
        encoder = Encoder(v)
        for batch in batches:
            for lo, hi, got, counts in encode_parts(encoder, batch.column(1)):
                coded = [hashlib.sha256(id_bytes(x)).hexdigest() for x in got]
                back = [hashlib.sha256(v.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in got]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts), pa.array(coded), pa.array(back)], schema.names)

    return map_texts(rows, run, schema)
