"""Lines that many documents share go everywhere but in one of them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import BLANKS, let

SALTS = 16  # parts of the documents that meet a shared line apart
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def dropped_lines(docs: DataFrame, min_length: int, min_docs: int) -> DataFrame:
    """Positions that go: doc_id, text_hash, drops (array of positions from 0).

    Lines are exploded as 128-bit hashes of their keys; texts stay where they are. Documents of a key are counted in two steps, first
    to distinct (key, doc_id), then by key with partial counts in each task, so a line that a third of all documents share is a few
    rows a task. The shared keys, which are few, are joined back in ``SALTS`` copies, each met by the documents of its part, so such a line
    is that many groups; beyond that, Spark's adaptive execution splits by skew.
    """
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    lines = lines.where(F.length("line") >= min_length).select("doc_id", "text_hash", "at", line_key(F.col("line")).alias("key"))
    lines = lines.where(F.length("key") >= min_length).select("doc_id", "text_hash", "at", F.unhex(F.md5("key")).alias("key"))
    lines = written(lines, "lines")  # hashes only; read twice
    # A document without an id is one document, smaller than any other.
    holders = lines.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("holder"))
    shared = holders.where(F.col("n_docs") >= min_docs).select("key", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gone = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(shared, ["key", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("drops"))


def without(text: Column, drops: Column) -> Column:
    """``text`` without its lines at the positions in ``drops``; unchanged where that is null."""
    kept = let(F.split(text, "\n"), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops), lambda i: lines[i]), "\n"))
    return F.when(drops.isNull(), text).otherwise(kept)


def dedup_lines(docs: DataFrame, *, min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with shared lines dropped from ``text``, and two more columns: n_lines (before) and n_dropped.

    Lines whose key has ``min_length`` code points or more and is found in ``min_docs`` documents (distinct doc_ids) or more stay only
    in the largest doc_id that holds them, there as often as they come. A null text is one empty line and stays null unless it loses
    it, which it can't. Rows with equal doc_id and text are treated alike; a null doc_id is an id of its own. Extra columns stay;
    columns that are called n_lines or n_dropped give way to these. An empty table gives an empty one.
    """
    drops = dropped_lines(docs.select("doc_id", "text"), min_length, min_docs).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "drops")
    left = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    both = left.join(drops, (F.xxhash64(text) == F.col("_hash")) & F.col("row.doc_id").eqNullSafe(F.col("_doc")), "left")
    out = [F.when(F.col("drops").isNull(), F.col("row.text")).otherwise(without(text, F.col("drops"))).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return both.select(*out, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))
