"""The pipeline against a plain version of its stages."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import langid, mixing, queries, toxicity
from tests.llm.test_neardup import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "mixing", "bpe"]


def test_equals_plain_version(spark):
    from tokenizers import Tokenizer

    table = pa.Table.from_pylist([r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()])
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    best, score = langid.fit(docs).predict(table.column("text").combine_chunks())
    table = table.filter(pa.array((best >= 0) & (score >= corpus_pipeline.LEAST_LANGUAGE_SCORE)))
    kept = spark.createDataFrame(table.to_pylist(), docs.schema)
    z = toxicity.fit(kept, spark.read.parquet(f"{DATA}/labels.parquet")).logits(table.column("text").combine_chunks())
    table = table.filter(pa.array(z < 0))
    rows = list(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()))
    alone = {k for k, _, _, keep in brute(rows, 5) if keep}
    table = table.filter(pa.array([k in alone for k, _ in rows]))
    con = duckdb.connect()
    con.register("documents", table)
    cur = con.execute(mixing.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    mixed = [dict(zip(names, r)) for r in cur.fetchall()]
    library = Tokenizer.from_file(queries.tokenizer_path())
    text = dict(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()))
    want = []
    for r in mixed:
        ids = library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        want += [(r["doc_id"], len(ids), np.array(ids, "<u4").tobytes())] * (r["taken"] // max(1, r["size"]))
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "source", "lang", "n_tokens", "token_ids"]
    assert sorted((r["doc_id"], r["n_tokens"], bytes(r["token_ids"])) for r in out.collect()) == sorted(want)


def test_stages_handle_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 1), (2, "", "en", "a", 0, 1), (3, "some plain words in a line", "en", None, 26, 1), (3, "some plain words in a line", "en", None, 26, 1), (None, "more plain words in the line", "en", "b", 28, 1)], "doc_id long, text string, lang string, source string, n_chars long, target int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, DATA)
            assert out.columns == docs.columns, name
            out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == 5
