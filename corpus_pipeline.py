"""The corpus pipeline: from raw documents to packed sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's ``docs``; all but the last return the columns of ``documents``. ``run`` does the same through
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mainswatt.llm import decontaminate, language, line_dedup, near_dup, packing
from mainswatt.sources.shared import materialise, scratch
from mainswatt.llm.queries import tokenizer_path

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language explains; the others go. Models are learnt from the labelled documents.

    Null and empty texts, and those without a letter, go. Repeated rows stay or go alike; of no documents none stay,
    and without any labelled document none is explained. Extra columns of any names stay.
    """
    models = language.fit(docs)
    return language.identify(docs, models, keep=docs.columns).filter(~F.col("rejected")).select("kept.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks that an earlier one holds; those with nothing left go.

    Null and empty texts stay, and so do documents without an id. Rows that repeat an id are edited alike. ``n_chars``
    is counted anew where lines went. Extra columns stay, whatever their names, but for those that the operator adds.
    """
    extra = {c: f"__own_{c}" for c in ("n_lines", "n_removed", "n_blocks") if c in docs.columns}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(extra)).filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{extra.get(c, c)}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each class of near duplicates. Documents without an id stay.

    Null and empty texts are classes of their own. Of rows that repeat an id one stays, of a hash of the text the
    least; of no documents none stay. Extra columns of any names stay.
    """
    own = materialise(near_dup.near_duplicates(docs))
    gone = own.filter("doc_id <> class_id").select(F.col("doc_id").alias("doc")).distinct()
    again = own.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select(F.col("doc_id").alias("doc"))
    kept = near_dup.without(docs, gone)
    if again.isEmpty():
        return kept
    once = near_dup.without(docs, gone.union(again).distinct())
    many = near_dup.only(kept, again).groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64("text")).alias("__row"))
    return once.unionByName(many.select("__row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even with other numbers or names.

    Null and empty texts hold none. Rows that repeat an id go together; documents without an id stay. An empty
    benchmark drops nothing. Extra columns of any names stay.
    """
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return near_dup.without(docs, materialise(found.select(F.col("doc_id").alias("doc")).distinct()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids of binary lengths.

    A null or empty text is one piece, the closing id. Repeated rows are packed each; of no documents come no
    pieces. Extra columns are not read, whatever their names.
    """
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of what a stage writes to the shared folder only its result outlives it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = materialise(stage(spark, docs, sf_dir))
            keep.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
