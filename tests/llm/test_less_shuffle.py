"""What near duplicates and the pipeline's filters send through a shuffle."""

import re

import numpy as np
from pyspark.sql import functions as F

from mainswatt.llm import near_dup


def test_unrelated_texts_do_not_meet(spark, monkeypatch):
    """Of 20,000 texts of words of their own hardly any share a node: equal tokens are no matter of chance."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"{w:x}" for w in rng.integers(0, 1 << 40, 8))) for i in range(20000)], "doc_id long, text string").repartition(4)
    written = []
    monkeypatch.setattr(near_dup, "materialise", lambda df, real=near_dup.materialise: written.append(real(df)) or written[-1])
    assert near_dup.near_duplicates(docs).filter("n_links > 0").isEmpty()
    together = [df for df in written if df.columns == ["path", "n"]]
    assert together and sum(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in together) < 100


def test_ids_are_left_out_without_a_shuffle_of_texts(spark):
    rows = [(i, f"t{i}", "x") for i in range(3000)] + [(7, "again", "x"), (8, "again", "x"), (None, "none", "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, page string").withColumnsRenamed({"page": "held"}).withColumns({c: F.lit(c) for c in ("page", "bit", "doc")})
    ids = spark.createDataFrame([(i,) for i in range(7, 3000, 50)], "doc long")
    for bits in (1 << 24, 64):  # with few bits every id may be one that goes
        out = near_dup.without(docs, ids, bits=bits)
        assert out.columns == docs.columns
        assert sorted(r.text for r in near_dup.only(docs, ids, bits=bits).collect()) == sorted(t for i, t, _ in rows if i is not None and i % 50 == 7)
        assert sorted(r.text for r in out.collect()) == sorted(t for i, t, _ in rows if i is None or i % 50 != 7)
    assert near_dup.without(docs, ids.limit(0)).count() == len(rows) and near_dup.without(docs.limit(0), ids).count() == 0


def test_pipeline_filters_shuffle_no_whole_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"word{i} some words of a text that stands for itself number{i} and more{i}", "en") for i in range(50)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/docs.parquet")
    spark.createDataFrame([(1, "word3 some words of a text that stands for itself number3 and more3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated):
        plan = stage(spark, spark.read.parquet(f"{tmp_path}/docs.parquet"), str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        straight = re.search(r"Union.*?\n((?:.|\n)*?)\n\+- ", plan)
        assert straight and "LeftAnti" not in straight.group(1), plan


def test_filters_meet_ids_after_the_bitmap(spark):
    """Anti and semi joins would move below the bitmap's join and shuffle every row."""
    spark.range(5000).selectExpr("id as doc_id", "concat('text ', id) as text").createOrReplaceTempView("docs_of_filters")
    docs, ids = spark.table("docs_of_filters"), spark.range(0, 5000, 50).withColumnRenamed("id", "doc")
    for filtered in (near_dup.without(docs, ids), near_dup.only(docs, ids)):
        plan = filtered._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan and "LeftSemi" not in plan, plan
    assert near_dup.without(docs, ids).count() == 4900 and near_dup.only(docs, ids).count() == 100


def test_few_tokens_are_shuffled_when_few_sets_split(spark, monkeypatch):
    """Of 6,000 texts of their own and 300 that nearly agree, hardly more than these send their tokens on."""
    rng = np.random.default_rng(5)
    rows = [" ".join(f"{w:x}" for w in rng.integers(0, 1 << 40, 8)) for _ in range(6000)]
    base = [f"{w:x}" for w in rng.integers(0, 1 << 40, 60)]
    rows += [" ".join(base[:-1] + [f"tail{k}"]) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    sent = []
    monkeypatch.setattr(near_dup, "_marked", lambda rows, ids, *bits, real=near_dup._marked: sent.append(real(rows, ids, *bits)) or sent[-1])
    out = near_dup.near_duplicates(docs, bucket=64)
    assert out.filter("class_id = 6000").count() == 300 and out.filter("n_links = 299").count() == 300
    tokens = [df.count() for df in sent if df.columns == ["doc", "tokens"]]
    assert tokens and max(tokens) < 600


def test_language_models_are_learnt_in_a_task(spark, monkeypatch):
    import os

    from mainswatt.llm import language

    docs = spark.createDataFrame([(i, f"ein kleiner satz {i}" if i % 2 else f"a little line {i}", "de" if i % 2 else "en") for i in range(60)], "doc_id long, text string, lang string")

    def here(self, texts, order=4, real=language.Models.train.__func__, driver=os.getpid()):
        assert os.getpid() != driver, "the driver learns"
        return real(self, texts, order)

    monkeypatch.setattr(language.Models, "train", classmethod(here))
    assert language.fit(docs).langs == ["de", "en"]
