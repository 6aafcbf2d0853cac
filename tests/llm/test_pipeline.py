"""The pipeline against a brute-force version, and every query with SQL against its SQL."""

import os
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
import corpus_pipeline
from tallyrisk.llm import pii, queries
from tallyrisk.llm.common import store

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connect  # noqa: E402


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_rows(spark, sf_dir, name):
    text, equal = compare(spark, connect(sf_dir), name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert equal, text


def test_pipeline(spark, sf_dir):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # too few labels here for any cutoff: the base rules decide alone
    kept = [(i, t) for i, t in rows if not brute.quality(t)[5]]
    classes = brute.simhash_classes(kept)
    kept = [(i, t) for i, t in kept if classes[i][1] == i]
    kept = [(i, t) for i, t in kept if not brute.contamination(t, items)[1]]
    want, terms = [], brute.disclosing(kept)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, t in kept:
        spans = [(pii.KINDS.index(k), s, e) for k, s, e in brute.personal(t) + brute.term_spans(t, terms)]
        ids = tokenizer.encode(pii.sanitised(t or "", spans), add_special_tokens=False).ids + [0]
        want += [(i, at, len(ids[at:at + 1024]), brute.crc(ids[at:at + 1024]), len(ids)) for at in range(0, len(ids), 1024)]
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(want)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"_words": F.lit("x"), "n_words": F.lit(1)})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() == 0
        docs = store(stage(spark, docs, sf_dir), name)
        assert docs.columns == out.columns and docs.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0
