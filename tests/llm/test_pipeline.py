"""The corpus pipeline against a plain version, stage by stage."""

import hashlib

import brute
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from roomledger.llm import langid, secretscan

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.Model(langid.labelled_sample(docs))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r, language in zip(rows, model.predict([t for _, t in rows])[0], strict=True) if language != "und"]
    known = docs.where(docs.doc_id.isin([i for i, _ in rows]))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, known, SF).collect()}
    assert kept == brute.kept_of_similar(rows, 0.8)
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute.contaminations(rows, items)}
    rows = [(i, secretscan.redact(t)) for i, t in rows if i not in leaked]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert leaked and len(rows) < docs.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_secrets_are_gone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = corpus_pipeline.secrets(spark, docs, "").collect()
    assert len(rows) == 1000 and all(r.n_chars == len(r.text) and not secretscan.all_spans(r.text) for r in rows)
