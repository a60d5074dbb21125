"""Evidence in a catalog table as events, and fragments in an object store, both by plain Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineamark.sources.store import latest

#: What an event of a new artifact is called.
STAGE, CREATED = "watermarking", "artifact_created"


class EventTable:
    """Events (model_name, stage, event_type, artifact_id, metadata as JSON, ingested) in a table of the catalog.

    The id stands beside the JSON, so that a look-up is pushed down to the files and needn't parse every row.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name

    def put(self, rows: DataFrame, ingested: int) -> None:
        """rows: artifact_id, model_id and any others, which go into the JSON with them."""
        events = rows.select(
            F.col("model_id").alias("model_name"),
            F.lit(STAGE).alias("stage"),
            F.lit(CREATED).alias("event_type"),
            F.col("artifact_id").cast("string").alias("artifact_id"),
            F.to_json(F.struct(*rows.columns)).alias("metadata"),
            F.lit(ingested).cast("long").alias("ingested"),
        )
        events.write.mode("append").saveAsTable(self.name)

    def events(self, model: str | None = None) -> DataFrame:
        every = self.spark.table(self.name).where((F.col("stage") == STAGE) & (F.col("event_type") == CREATED))
        return every if model is None else every.where(F.col("model_name") == model)

    def get(self, artifact_id, schema: str) -> DataFrame:
        """The last evidence of an id, parsed by schema."""
        own = self.events().where(F.col("artifact_id") == str(artifact_id))
        return latest(own).select(F.from_json("metadata", schema).alias("e")).select("e.*")

    def by_model(self, model: str, schema: str, version: str | None = None, limit: int | None = None) -> DataFrame:
        rows = latest(self.events(model)).select(F.from_json("metadata", schema).alias("e")).select("e.*")
        rows = rows if version is None else rows.where(F.col("model_version") == version)
        return rows if limit is None else rows.orderBy("artifact_id").limit(limit)


class FragmentStore:
    """Fragments (fragment_id, data) as Parquet in any folder that Spark reaches, in buckets by hash of the id."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, column):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def put(self, rows: DataFrame, number: int) -> None:
        """number orders puts: the last one of an id counts."""
        rows.select(
            "fragment_id",
            "data",
            F.lit(number).cast("long").alias("ingested"),
            self._bucket(F.col("fragment_id")).alias("bucket"),
        ).write.mode("append").partitionBy("bucket").parquet(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("fragment_id string, data binary, ingested long, bucket int").parquet(self.path)

    def get(self, fragment_id: str) -> DataFrame:
        """One row or none; only the id's bucket is read."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(fragment_id))).first()[0]
        return latest(
            self._rows().where((F.col("bucket") == bucket) & (F.col("fragment_id") == fragment_id)),
            "fragment_id",
        ).where("data is not null").select("fragment_id", "data")

    def ids(self, prefix: str = "") -> DataFrame:
        own = self._rows().where(F.col("fragment_id").startswith(prefix))
        return latest(
            own.select("fragment_id", "ingested", F.col("data").isNull().alias("gone")),
            "fragment_id",
        ).where("not gone").select("fragment_id")

    def delete(self, ids: DataFrame, number: int) -> None:
        """A put of nothing: nulls take the place of the data, and no bucket is rewritten."""
        self.put(ids.select("fragment_id", F.lit(None).cast("binary").alias("data")), number)
