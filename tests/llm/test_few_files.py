"""Small tables between the steps of near duplicates are written in few files, however many tasks make them."""

import os

import numpy as np

from mainswatt.llm import near_dup, super_minhash
from mainswatt.sources.shared import few_files, materialise


def _files(df):
    return sum(f.endswith(".parquet") for f in os.listdir(df._shared_path.removeprefix("file:")))


def test_small_results_of_many_tasks_are_one_file(spark):
    rows = spark.range(0, 10000, 1, 24).filter("id % 100 = 0")
    assert _files(materialise(rows)) == 24
    packed = materialise(few_files(rows))
    assert _files(packed) == 1 and sorted(r.id for r in packed.collect()) == list(range(0, 10000, 100))


def test_near_duplicates_write_few_files(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"{w:x}" for w in rng.integers(0, 1 << 40, 8)) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:600])) + [(9000 + k, t + " tail") for k, t in enumerate(texts[:600])], "doc_id long, text string").repartition(16)
    for module, kind in ((near_dup, {"threshold": 0.8, "shingle": 1}), (super_minhash, {"threshold": 0.85, "shingle": 1})):
        written = []
        monkeypatch.setattr(module, "materialise", lambda df, real=module.materialise: written.append(real(df)) or written[-1])
        out = module.near_duplicates(docs, **kind)
        assert out.count() == 4200
        of = "class_id" if module is near_dup else "component_id"
        assert out.filter(f"doc_id >= 9000 and {of} = doc_id - 9000").count() > 590
        small = [_files(df) for df in written if "path" in df.columns or df.columns[:2] == ["a", "b"]]
        assert len(small) >= 3 and sum(small) <= len(small) + 7, (module.__name__, small)
