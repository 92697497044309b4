import random

import pytest

import corpus_pipeline
from tagframe.llm import minhash_dedup, sentencepieces

from .conftest import DOCS, doc
from .test_minhash_dedup import brute
from .test_mixing import scheduled
from .test_quality import text

import os

pytestmark = pytest.mark.skipif(not os.path.exists(sentencepieces.MODEL), reason="no public tokenizers here")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd, d = random.Random(9), str(tmp_path_factory.mktemp("sf"))
    rows = [doc(i, text(i % 5 != 0, rnd), source=rnd.choice("abc")) for i in range(300)]
    rows += [doc(1000 + k, rows[k + 1][1], source="c") for k in range(0, 40, 5)] + [doc(2000, None), doc(2001, ""), doc(2002, "123 456")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(300)], "doc_id bigint, quality int").write.parquet(f"{d}/labels.parquet")
    return d


def test_each_stage_on_what_the_one_before_kept(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = df.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, sf_dir)
        if k < 4:
            assert out.columns == columns
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
        if k == 2:
            rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
            assert kept[2] == {i for i, _, c in brute(rows, 5, 80) if i == c}
        df = out
    bad = {i for i in range(300) if i % 5 == 0}
    assert len(kept[0] & bad) <= 3 and len(set(range(300)) - bad - kept[0]) <= 3
    assert not kept[1] & {2000, 2001, 2002}
    assert not kept[2] & {1000 + k for k in range(0, 40, 5) if (k + 1) in kept[2]}
    assert kept[3] == kept[2] == kept[4]
    assert corpus_pipeline.run(spark, sf_dir).count() == len(kept[4])


def test_the_order_reaches_the_end(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).select("doc_id", "source", "slot", "place").collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(CAST(doc_id AS STRING)) AS h").collect()}
    assert [(r.doc_id, r.slot, r.place) for r in rows] == scheduled({r.doc_id: r.source for r in rows}, hashes)


def test_empty_and_repeated_documents(spark, sf_dir, docs, no_docs):
    for df in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, sf_dir).count() <= df.count(), name
    once = corpus_pipeline.one_of_each_group(spark, docs, sf_dir)
    assert once.where("doc_id = 10").count() == 1
    assert minhash_dedup.near_duplicates(docs).where("doc_id = 10 AND kept").count() == 2
