"""A training corpus from ``documents``: rules, shared lines, near duplicates, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes as Parquet and reads again as the next one's docs. All
but the last return the columns of ``documents``. As its input is written, a stage deletes the scratch tables of the stages before it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gaugeflow.llm import jaccard, linededup, mixing, packing, quality
from gaugeflow.llm.store import collecting, forget, release, written
from gaugeflow.llm.tokens import vocabulary_path


_scratch: list[str] = []  # tables that stages wrote and that are not deleted yet


def _after(stage):
    """A stage that follows others: their scratch tables go first, but for those that its input still reads."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(docs, _scratch)
        with collecting(_scratch):
            return stage(spark, docs, sf_dir)

    return run_stage


def _first(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with collecting(_scratch):
            return stage(spark, docs, sf_dir)

    return run_stage


@_first
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


@_after
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the last of them only. n_chars follows the text."""
    return _with_n_chars(linededup.dedup_lines(docs).select(*[f"`{c}`" for c in docs.columns]))


@_after
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return jaccard.keep_one(docs)


@_after
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, cut where a source's target ends. n_chars follows the text."""
    return _with_n_chars(mixing.mix(docs))


@_after
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary_path("byte_bpe_50k.json"))


def _with_n_chars(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("source mix", source_mix),
    ("packing", packed_sequences),
]

#: Posterior weights found by EM and tokenizer ids have no SQL form; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            before, docs = docs, written(out, name.replace(" ", "-"))
            forget(before)
    return out
