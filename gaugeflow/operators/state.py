"""Identity and memory of stages: content hashes, signature chains, an append-only log."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_identity(rows: DataFrame, by: list[str], order: str, columns: list[str], fan: int = 4096) -> DataFrame:
    """A digest of each group's rows, whatever order they come in: rows are hashed one by one, spans of ``fan`` values of ``order`` from their rows' hashes, spans of spans from theirs, and groups from those.

    So what is gathered at once is 64 characters a row of a span, a span of a span of spans, and a group's size over ``fan`` squared.
    """
    row = F.sha2(F.concat_ws(",", F.col(order).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), 256)
    level = rows.select(*by, F.col(order).cast("long").alias("_o"), row.alias("_h"))
    joined = F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda x: x["_h"])), 256)
    for _ in range(2):
        level = level.groupBy(*by, F.expr(f"_o DIV {fan}").alias("_s")).agg(joined.alias("_h")).select(*by, F.col("_s").alias("_o"), "_h")
    return level.groupBy(*by).agg(F.concat(F.lit("sha256:"), joined).alias("identity"))


def file_identity(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of files, read by Spark; a file is a row, so it has to fit a task."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def artifact_records(spark: SparkSession, path: str, role: str) -> DataFrame:
    """role, path, size and SHA-256 of the files at ``path``."""
    return file_identity(spark, path).select(F.lit(role).alias("role"), "path", "size", "sha256")


def capture_fingerprint(files: DataFrame, tables: DataFrame) -> DataFrame:
    """case_id, fingerprint: a digest of a capture's table files in full (``tables``: case_id, name, content) and of the number, first and last names, and bytes in all, of its other files (``files``: case_id, kind, name, size), which aren't read."""
    text = tables.groupBy("case_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "name", F.sha2(F.col("content").cast("binary"), 256)))).alias("_t"))
    kinds = files.groupBy("case_id", "kind").agg(F.concat_ws(":", "kind", F.count(F.lit(1)).cast("string"), F.min("name"), F.max("name"), F.sum("size").cast("string")).alias("_k")).groupBy("case_id").agg(F.array_sort(F.collect_list("_k")).alias("_k"))
    return text.join(kinds, "case_id", "full_outer").select("case_id", F.sha2(F.concat_ws("|", F.coalesce("_t", F.array().cast("array<string>")), F.coalesce("_k", F.array().cast("array<string>"))), 256).alias("fingerprint"))


def stage_signature(stage: str, capture: str, parameters: dict, dependency: str | None, version: str) -> str:
    """SHA-256 of sorted JSON; the dependency's signature is part of it, so a change runs down the chain."""
    import hashlib

    body = {"stage": stage, "capture": capture, "parameters": parameters, "dependency": dependency, "version": version}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def latest_state(log: DataFrame, case: str, stage: str, sequence: str, value: list[str]) -> DataFrame:
    """The last row of each case and stage of an append-only log."""
    return log.groupBy(case, stage).agg(F.max(F.struct(sequence, *value)).alias("m")).select(case, stage, "m.*")


def is_current(status: F.Column, signature: F.Column, wanted: F.Column) -> F.Column:
    """Complete with the wanted signature; a null is not current."""
    return F.coalesce((status == "complete") & (signature == wanted), F.lit(False))


class StageLog:
    """Stages of a case in an append-only Parquet log; a stage runs unless its last entry is complete with the same signature."""

    schema = "case_id string, stage string, sequence long, status string, signature string, parameters string, error string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        if self._missing():
            spark.createDataFrame([], self.schema).write.parquet(path)

    def _missing(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _append(self, case: str, stage: str, status: str, signature: str, parameters: dict, error: str | None = None) -> None:
        # Writers take the time as the number, so none has to read what others append meanwhile.
        self.spark.createDataFrame([(case, stage, time.time_ns(), status, signature, json.dumps(parameters, sort_keys=True), error)], self.schema).write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        return latest_state(self.spark.read.schema(self.schema).parquet(self.path), "case_id", "stage", "sequence", ["status", "signature", "parameters", "error"])

    def run(self, case: str, stage: str, signature: str, parameters: dict, action: Callable[[], None]) -> bool:
        """True if it ran. A failure is logged and raised."""
        last = self.latest().where((F.col("case_id") == case) & (F.col("stage") == stage)).first()
        if last and last["status"] == "complete" and last["signature"] == signature:
            return False
        self._append(case, stage, "running", signature, parameters)
        try:
            action()
        except Exception as error:
            self._append(case, stage, "failed", signature, parameters, str(error))
            raise
        self._append(case, stage, "complete", signature, parameters)
        return True


def variant_grid(variants: DataFrame, depths: list[int]) -> DataFrame:
    """Every variant with every depth of a fixed list."""
    return variants.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))
