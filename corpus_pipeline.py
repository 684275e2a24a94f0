"""The training-data pipeline: each stage takes (spark, docs, sf_dir) and its result is written and read again for the next.

Stages judge rows one by one, so ids may be null or repeated, and keep all columns of docs, whatever their names. Null and empty
texts are documents like any other (one of them passes near-dedup). An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import decontaminate, packing, quality
from framesift.llm.common import crc_fold, materialize
from framesift.llm.near_dedup import one_of_each
from framesift.llm.queries import table, vocabulary
from framesift.llm.substring_dedup import remove_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), keep=crc_fold("doc_id", 3) != 1)
    scored = quality.score(docs.select(F.struct(*docs.columns).alias("kept"), "text"), model)
    return scored.where("quality_score >= 0.5").select("kept.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (candidates by SimHash and minhashes, five-word similarity of 0.8 or more): that with the smallest id."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; a text that loses none stays as it is. `n_chars` follows the text, where there is one."""
    others = [c for c in docs.columns if c != "text"]
    found = remove_repeats(docs.select(F.struct(*others).alias("others"), "text"), carry=("others", "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col("others")[c]).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows of token ids."""
    return packing.pack(docs, *vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packed_sequences),
]
#: The stages learn models and pack token ids, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
