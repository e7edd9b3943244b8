"""Stored tables: Parquet, optionally partitioned by month or split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headed CSV by the names in its header, in the schema's order and types."""
    return by_name(read_header_csv(spark, path), schema)


def read_header_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a headed CSV as text, lower-cased; of names that collide the first stays.

    Values follow the file's own header, never the order of a schema; a row with too few or
    too many values raises.
    """
    plain = spark.read.option("header", False).csv(path).first()
    header = [(name or "").strip().lower() for name in plain] if plain else []
    schema = ", ".join(f"_{i} STRING" for i in range(len(header))) or "_0 STRING"
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    first = {name: i for i, name in reversed(list(enumerate(header)))}
    return rows.select(*[F.col(f"_{i}").alias(name) for name, i in sorted(first.items(), key=lambda p: p[1])])


def by_name(rows: DataFrame, schema: str | StructType) -> DataFrame:
    """Columns picked by name, without regard to case, and cast; what is missing or no value raises."""
    fields = schema.fields if isinstance(schema, StructType) else StructType.fromDDL(schema).fields
    there = {c.lower() for c in rows.columns}
    if absent := [f.name for f in fields if f.name.lower() not in there]:
        raise ValueError(f"columns missing from the header: {', '.join(absent)}")
    return rows.select(*[F.col(f"`{f.name.lower()}`").cast(f.dataType).alias(f.name) for f in fields])


def read_demand_series(spark: SparkSession, path: str) -> DataFrame:
    """Demand ordered by zone and date.  The order is for readers of the result; operators
    that depend on order state it in their window."""
    return read_table(spark, path).select("zone", "date", "demand", "is_imputed").orderBy("zone", "date")


def read_split(spark: SparkSession, path: str, *splits: str) -> DataFrame:
    """Rows of the named splits; other splits' folders are not opened."""
    return read_table(spark, path).filter(F.col("split").isin(*splits))
