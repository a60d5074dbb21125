"""Evidence store: appended Parquet, partitioned by model; the latest row of each artifact counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class EvidenceStore:
    """Rows have artifact_id, model_id, model_version, watermark_id and any others; ingested orders repeated ids."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame, ingested: int) -> None:
        rows.withColumn("ingested", F.lit(ingested).cast("long")).write.mode("append").partitionBy("model_id").parquet(self.path)

    def rows(self) -> DataFrame:
        return latest(self.spark.read.parquet(self.path))

    def get(self, artifact_id) -> DataFrame:
        return latest(self.spark.read.parquet(self.path).where(F.col("artifact_id") == F.lit(artifact_id)))

    def by_model(self, model_id: str, version: str | None = None, limit: int | None = None) -> DataFrame:
        """Artifacts whose latest row is of this model. Only ids that the model's partition holds are looked up elsewhere."""
        every = self.spark.read.parquet(self.path)
        own = every.where(F.col("model_id") == model_id).select("artifact_id").distinct()
        return by_model(latest(every.join(own, "artifact_id", "left_semi")), model_id, version, limit)

    def by_watermark(self, watermark_id: str) -> DataFrame:
        return self.rows().where(F.col("watermark_id") == watermark_id).orderBy("artifact_id").limit(1)

    def counts(self) -> DataFrame:
        return self.rows().groupBy("model_id").agg(F.count("*").alias("n"))

    def models(self) -> DataFrame:
        return self.rows().select("model_id").distinct().orderBy("model_id")

    def delete(self, ids: DataFrame, to: str) -> EvidenceStore:
        """What is left without ids (artifact_id), as a new store."""
        self.rows().join(ids, "artifact_id", "left_anti").write.partitionBy("model_id").parquet(to)
        return EvidenceStore(self.spark, to)


def latest(rows: DataFrame, key: str = "artifact_id", order: str = "ingested") -> DataFrame:
    """One row for each key, the last by order; of rows that tie, that of the greatest hash, so that reads agree."""
    last = rows.groupBy(F.col(key)).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(order), F.xxhash64(*rows.columns))).alias("last"))
    return last.select("last.*")


def by_model(rows: DataFrame, model_id: str, version: str | None = None, limit: int | None = None) -> DataFrame:
    rows = rows.where(F.col("model_id") == model_id)
    rows = rows.where(F.col("model_version") == version) if version is not None else rows
    return rows.orderBy("artifact_id").limit(limit) if limit is not None else rows


def read_json(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """Evidence as JSON, a record on each line, or in each file if whole; malformed ones are left out."""
    texts = spark.read.text(path, wholetext=whole)
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return texts.select(parsed.alias("e")).where("e is not null and e._corrupt_record is null").select("e.*").drop("_corrupt_record")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
