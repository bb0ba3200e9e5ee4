"""BPE and token counts against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lakeloom.llm import bpe, queries, token_counts

DATA = "/root/testdata/sf0.001"
TEXTS = ["", " ", "it's we'll've 's\n's", "aaaa aaaaaaa", "a \n  b", "<|endoftext|>", "a <|endoftext|>b<|endoftext|><|endoftext|> ", "é's 日本 ١٢", "x\x1cy\x85z", " 　 a", "🙂👍🏽", "'", "x" * 3000]


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


def fuzz(n):
    rng = random.Random(4)
    return ["".join(rng.choice("abst'rvemld  \n\t.,!12é  ñ日<|🙂") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_library(path, library):
    texts = TEXTS + fuzz(3000)
    ids, counts = bpe.encode_batch(bpe.Encoder(bpe.vocabulary(path)), pa.array(texts))
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [i.tolist() for i in ids] == [w.ids for w in want] and counts.tolist() == [len(w.ids) for w in want]
    v = bpe.vocabulary(path)
    assert [v.decode(i).decode() for i in ids] == [library.decode(w.ids, skip_special_tokens=False) for w in want]


def test_every_code_point(path, library):
    encoder = bpe.Encoder(bpe.vocabulary(path))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 100_000):
        texts = [f"a{c}1 {c}b {c} " for c in points[i : i + 100_000]]
        ids, _ = bpe.encode_batch(encoder, pa.array(texts))
        assert [x.tolist() for x in ids] == [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]


def test_index_against_plain_merging(path):
    """The pair index against merging the lowest rank again and again."""
    v = bpe.vocabulary(path)
    rank = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(v.left, v.right))}

    def plain(word):
        ids = [int(v.of_byte[b]) for b in word]
        while True:
            best = min((rank[p] for p in zip(ids, ids[1:]) if p in rank), default=None)
            if best is None:
                return ids
            a, b, out, i = int(v.left[best]), int(v.right[best]), [], 0
            while i < len(ids):
                if ids[i] == a and ids[i + 1 : i + 2] == [b]:
                    out.append(int(v.merged[best]))
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out

    words = [w.encode() for w in "hello aaaaaaaaa abababab thethethe nnnnnnnnnnnnnnn mississippi".split()]
    ids, n = v.encode_words(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain(w) for w in words]


def test_long_text_in_pieces(path, library, monkeypatch):
    monkeypatch.setattr(bpe, "MERGE_BYTES", 1 << 12)
    texts = ["word 12 " * 5000, "y" * 40_000, "a", "end\n\n " * 3000]
    ids, _ = bpe.encode_batch(bpe.Encoder(bpe.vocabulary(path)), pa.array(texts))
    assert [i.tolist() for i in ids] == [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]


def test_table_is_bounded(path, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_WORDS", 5)
    e = bpe.Encoder(bpe.vocabulary(path))
    first = [bpe.encode_batch(e, pa.array([t]))[0][0].tolist() for t in ("a b c d e f g h", "i j k l", "a b c d e f g h")]
    assert first[0] == first[2] and len(e.len) < 20


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)] + [(None, "a b", "x", 7)], "doc_id long, text string, decoded2 string, ids int")


def test_encode_decode_frames(spark, path):
    df = frame(spark, [*TEXTS, None])
    coded = bpe.encode(df, path)
    assert coded.columns == ["doc_id", "text", "decoded2", "ids", "n_tokens", "token_ids"]
    back = bpe.decode(coded, path).collect()
    assert len(back) == len(TEXTS) + 2 and all(r["decoded"] == (r["text"] or "") for r in back)
    with pytest.raises(ValueError):
        bpe.encode(coded, path)
    assert bpe.digests(df.limit(0), path).count() == 0


def test_op4_round_trip(spark, library):
    got = {r["doc_id"]: r for r in queries.op4_bpe(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op2_counts(spark, library):
    got = {r["doc_id"]: r for r in queries.op2_token_counts(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(library.encode(d["text"] or "", add_special_tokens=False).ids)
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((d["text"] or "").encode()), n > 1024)


def test_cache_is_filled_once(spark, path, tmp_path):
    cache = f"file://{tmp_path}/cache"
    df = frame(spark, ["one two", "one two", None, "", "three"])
    first = sorted(map(tuple, token_counts.count_tokens(df, path, cache).collect()), key=repr)
    assert len(first) == 6 and spark.read.parquet(cache).count() == 4  # one two, empty, three, a b
    again = frame(spark, ["one two", "one two", None, "", "three", "four"])
    out = token_counts.count_tokens(again, path, cache)
    assert out.count() == 7 and spark.read.parquet(cache).count() == 5
    other = queries.tokenizer_path("word_bpe_49k.json")
    assert token_counts.count_tokens(again, other, cache).count() == 7
    assert spark.read.parquet(cache).count() == 10
    assert token_counts.count_tokens(df.limit(0), path, cache).count() == 0


@pytest.mark.parametrize("most", [500_000, 1])
def test_warm_cache_moves_misses_only(spark, path, tmp_path, monkeypatch, most):
    """Counts of a table of which half is known; what the cache knows isn't read from it again."""
    monkeypatch.setattr(token_counts, "BROADCAST_IDS", most)
    cache = f"file://{tmp_path}/cache{most}"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    first = {r["doc_id"]: tuple(r) for r in token_counts.count_tokens(docs.filter("doc_id % 2 = 0"), path, cache).collect()}
    known = spark.read.parquet(cache).count()
    both = {r["doc_id"]: tuple(r) for r in token_counts.count_tokens(docs, path, cache).collect()}
    assert all(both[k] == v for k, v in first.items()) and len(both) == docs.count()
    cold = {r["doc_id"]: tuple(r) for r in token_counts.count_tokens(docs, path, f"file://{tmp_path}/cold{most}").collect()}
    assert both == cold
    rows = spark.read.parquet(cache)
    assert known < rows.count() == rows.select("content_digest").distinct().count() == docs.select("text").distinct().count()


def test_hits_are_not_shuffled(spark, path, tmp_path):
    """The texts are reduced to the misses before any exchange, also with automatic broadcasts off."""
    cache = f"file://{tmp_path}/cache"
    df = frame(spark, [f"text {i}" for i in range(50)])
    token_counts.count_tokens(df, path, cache).count()
    digests = df.select(token_counts.content_digest(df["text"]).alias("content_digest"))
    assert token_counts.missing(digests, token_counts.read_cache(spark, cache, path)).count() == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        lacking = token_counts.missing(digests.limit(1).unionByName(digests.limit(0)), spark.createDataFrame([], "content_digest binary, n_tokens long"))
        plan = token_counts.contents(df, lacking)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")  # plans print from the top


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name):
    path = queries.tokenizer_path(name)
    texts = ["Hello  World", "", None, "naïve 日本"]
    got = list(token_counts.counter(path)(pa.array(texts, pa.string())))
    if name.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        assert got == [len(m.encode(t or "")) for t in texts]
    else:
        m = Tokenizer.from_file(path)
        assert got == [len(m.encode(t or "", add_special_tokens=False).ids) for t in texts]
