"""The corpus pipeline: stages over ``documents``, each written as Parquet and
read again as the next one's input.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept; all but the last return the columns of ``docs``.  Rows without an id pass the
stages that need one unless their text is rejected, since nothing can be linked to
them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekpanel.llm import bloom
from weekpanel.llm.decontaminate import contaminated
from weekpanel.llm.language import fit_language, language_of
from weekpanel.llm.minhash import near_duplicates
from weekpanel.llm.packing import pack
from weekpanel.llm.quality import fit_quality, score_column
from weekpanel.llm.text import remainder, table
from weekpanel.session import materialize

MIN_QUALITY = 0.3
JUDGED = "corpus_pipeline_verdict"  # a column of this name in ``docs`` would be replaced


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; learns from the languages of ``docs``."""
    model = fit_language(docs.filter(remainder("doc_id", 5) != 0))
    judged = docs.withColumn(JUDGED, language_of(docs, model, F.col("text")))
    return judged.filter(~F.col(f"{JUDGED}.rejected")).drop(JUDGED)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score reaches ``MIN_QUALITY``; learns from ``labels``."""
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    model = fit_quality(docs, labels)
    judged = docs.withColumn(JUDGED, score_column(docs, model, F.col("text")))
    return judged.filter(F.col(JUDGED) >= MIN_QUALITY).drop(JUDGED)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group.

    A Bloom filter of the other ids lets nearly all kept texts pass without a
    shuffle; only rows it may hold meet the exact ids."""
    dropped = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias(JUDGED)).distinct()
    dropped = materialize(dropped, "dropped")
    marked = docs.withColumn(JUDGED + "_2", F.coalesce(bloom.maybe_listed(docs, bloom.build(dropped, JUDGED), F.col("doc_id")), F.lit(False)))
    passed = marked.filter(~F.col(JUDGED + "_2")).drop(JUDGED + "_2")
    looked_at = marked.filter(JUDGED + "_2").drop(JUDGED + "_2").join(dropped, F.col("doc_id") == F.col(JUDGED), "left_anti")
    return _one_row_per_id(passed.union(looked_at))


def _one_row_per_id(docs: DataFrame) -> DataFrame:
    """Of rows that repeat an id, the one with the smallest text stays."""
    repeated = materialize(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(JUDGED)), "repeated")
    if repeated.isEmpty():
        return docs
    same = F.col("doc_id") == F.col(JUDGED)
    first = Window.partitionBy("doc_id").orderBy("text")
    one = docs.join(repeated, same, "left_semi").withColumn(JUDGED, F.row_number().over(first)).filter(F.col(JUDGED) == 1).drop(JUDGED)
    return docs.join(repeated, same, "left_anti").union(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a (near) copy of a benchmark item.

    The ids are written first: few, so the planner sees their size and broadcasts
    them; should they be many, it joins by sort and merge."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(JUDGED)).distinct()
    return docs.join(materialize(leaks, "leaks"), F.col("doc_id") == F.col(JUDGED), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("packing", packing),
]

ORACLE_SQL = None  # trained stages and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
