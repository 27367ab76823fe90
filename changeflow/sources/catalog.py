"""Catalog facts from a table snapshot or a JDBC table, tolerant of versions that lack a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from changeflow.schemas import PUBLICATION_TABLES, SLOT_STATUS


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of the schema in its types; absent columns are typed NULLs, `t`/`f` text becomes boolean."""
    present = set(df.columns)
    columns = []
    for field in StructType.fromDDL(ddl):
        value = F.col(field.name) if field.name in present else F.lit(None)
        if field.dataType.simpleString() == "array<string>" and dict(df.dtypes).get(field.name) == "string":
            value = F.from_json(value, "array<string>")
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def read_slot_status(snapshot: DataFrame) -> DataFrame:
    """Slot facts; a row without a slot type describes a slot that does not exist."""
    facts = conform(snapshot, SLOT_STATUS)
    extra = [c for c in snapshot.columns if c not in facts.columns]
    if not extra:
        return facts.withColumn("present", F.col("slot_type").isNotNull())
    kept = snapshot.select(*extra, F.struct(*snapshot.columns).alias("_row"))
    fields = StructType.fromDDL(SLOT_STATUS)
    columns = [
        (F.col(f"_row.{f.name}") if f.name in snapshot.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ]
    return kept.select(*extra, *columns).withColumn("present", F.col("slot_type").isNotNull())


def read_publication_tables(snapshot: DataFrame) -> DataFrame:
    facts = conform(snapshot, PUBLICATION_TABLES)
    return facts.withColumn(
        "replica_identity_columns", F.coalesce("replica_identity_columns", F.array().cast("array<string>"))
    )


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> DataFrame:
    return spark.read.jdbc(url, table, properties=properties)
