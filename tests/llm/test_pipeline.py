"""The pipeline's stages, one after the other, on planted and edge rows."""

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from ledgerline.llm import byte_bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path, edge_rows):
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    real = spark.read.parquet(f"{sf}/documents.parquet")
    base = [tuple(r) for r in real.orderBy("doc_id").collect()]
    clean = next(t for _, t, lang, _, n in base if lang == "en" and 1200 < n < 2500)
    planted = [(500_001, clean.replace(". ", f". {item} ", 1), "en", "p", 0), (500_002, item, "en", "p", 0),
               (500_003, "Mail to joe@example.com at once", "en", "p", 0), (500_004, "12345 !!! 678", "en", "p", 0),
               (500_005, None, None, None, None)]
    edge = [(None if r[0] is None else r[0] + 600_000, *r[1:]) for r in edge_rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(base + planted + edge, schema)
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], sf)
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in seen]
    assert not {500_004, 500_005} & set(ids[1]) and {500_001, 500_002, 500_003} <= set(ids[1])
    assert len(ids[2]) < len(ids[1]) and len(set(ids[2])) == len(ids[2])
    assert 500_002 not in ids[3] and 500_003 in ids[3]
    texts = {r["doc_id"]: r for r in seen[4].collect()}
    assert "[EMAIL]" in texts[500_003]["text"] and "joe@" not in texts[500_003]["text"]
    for r in texts.values():
        assert r["n_chars"] == len(r["text"])
        assert item not in r["text"]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    last = seen[5].collect()
    assert len(last) == len(ids[4])
    for r in last:
        assert r["ids"] == enc.encode_ordinary(texts[r["doc_id"]]["text"]) and len(r["ids"]) == r["n_tokens"]


def test_run_equals_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))


@pytest.mark.parametrize("k", range(5))
def test_no_rows_and_more_columns(spark, k):
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, `row` int, key_0 string, `n w` double"
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, spark.createDataFrame([], schema), sf).collect() == []
    rows = spark.createDataFrame([(1, "a plain text of the table", "en", "s", 9, 5, "k", 0.5)] * 2, schema)
    out = stage(spark, rows, sf)
    assert out.count() == (1 if name == "near_dedup" else 2)
    if k < 4:
        assert out.columns == rows.columns and out.first()["key_0"] == "k"
