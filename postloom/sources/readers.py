"""Readers of posts and pages. Paths may be of any store that Spark reads; schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom import schemas


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Canonical posts from JSON arrays or lines; a file that isn't such JSON fails the job."""
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schemas.CANONICAL_POST])
    rows = spark.read.schema(text).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(*[F.try_to_timestamp(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in schemas.CANONICAL_POST])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(pages: DataFrame) -> DataFrame:
    """S3: raw pages (page_key, url, html) with content_type, which says whether a body is HTML or feed JSON."""
    return pages.withColumn("content_type", F.when(F.ltrim("html").startswith("{"), "feed_json").otherwise("html"))


def evolve(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """A table read with a later schema: missing columns come with their defaults."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit((defaults or {}).get(f.name))).cast(f.dataType).alias(f.name) for f in schema])
