"""One text of 20 MB through every operator that works on pieces of texts, and through the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import common, decontaminate, language_id, near_dedup, packing, quality_classifier

SMALL = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"benchmark{k}" for k in range(40))


@pytest.fixture(scope="module")
def long_docs(make):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    lines = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(280_000)]
    text = "\n".join(lines)
    copy = "\n".join(line if k % 25 else "another line stands here " + str(k) for k, line in enumerate(lines)) + "\n" + PASSAGE
    assert len(text) > 20_000_000
    return make([(1, text, "en", "a"), (2, copy, "en", "b"), (3, "x" * 3_000_000, "en", "b"), (4, "a short text of few words", "en", "b")])


def test_near_copies_of_long_texts_are_found(long_docs):
    assert [(r.keeper_id, r.doc_id) for r in near_dedup.pairs(long_docs).collect()] == [(1, 2)]


def test_a_passage_at_the_end_of_a_long_text_is_removed(long_docs, spark):
    items = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(long_docs, items).select("doc_id", "benchmark_items", "words_removed", F.length("text").alias("n"), F.expr("right(text, 30)").alias("end")).collect()}
    assert list(out[2].benchmark_items) == [7] and out[2].words_removed == 40 and "benchmark" not in out[2].end and not out[1].benchmark_items and set(out) == {1, 2, 3, 4}


def test_long_texts_are_scored_and_identified(long_docs, spark):
    labels = common.table(spark, SMALL, "labels")
    rows = quality_classifier.classify(long_docs.withColumn("doc_id", F.col("doc_id") - 100), labels, drop=("text",)).collect()
    assert len(rows) == 4 and all(0 <= r.quality_score <= 1 for r in rows)
    sample = language_id.train(common.table(spark, SMALL, "documents"))
    rows = {r.doc_id: r for r in language_id.identify(long_docs, sample, drop=("text",)).collect()}
    assert rows[1].lang_id is not None and rows[1].code_bits > 2e7
    coder = language_id.Coder({n: language_id.Trees(t, 4) for n, t in sample.items()}, 4)
    data = np.full(3_000_000, ord("x"), np.uint8)  # document 3, without blocks
    assert rows[3].code_bits == pytest.approx(coder._code_lengths(data, np.array([0, len(data)])).min(), rel=1e-6)


def test_tokens_of_long_texts_are_counted_whole(long_docs):
    out = packing.pack(long_docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    encode = packing.encoder(packing.PackParams()).encode_ordinary
    text = long_docs.filter("doc_id = 2").first().text
    parts = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert len(out) == 4 and {r.doc_id: r.n for r in out}[4] == len(encode("a short text of few words")) + 1
    # a lone line end between words is a token of its own, so lines can be counted one by one
    assert {r.doc_id: r.n for r in out}[2] == sum(len(encode(p.rstrip("\n"))) + p.endswith("\n") for p in parts) + 1


def test_the_pipeline_takes_long_texts(long_docs, spark):
    import corpus_pipeline

    docs = long_docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = common.stored(stage(spark, docs, SMALL))
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} >= {1, 3, 4}
