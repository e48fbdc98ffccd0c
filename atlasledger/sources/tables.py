"""Catalogue tables on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasledger import schema
from atlasledger.functions.labels import known_state


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One catalogue table with its declared types (no inference)."""
    return spark.read.schema(schema.struct(table)).parquet(f"{root}/{table}")


def write_table(df: DataFrame, root: str, table: str, mode: str = "overwrite") -> None:
    """Write a catalogue table; blob content stays logical, the codec compresses it."""
    df.write.mode(mode).option("compression", "zstd").parquet(f"{root}/{table}")


def layer_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(schema.LAYERS, schema.LAYER_SCHEMA)


def unknown_states(scans: DataFrame) -> DataFrame:
    """Scan rows whose state is none of the declared ones."""
    return scans.where(~known_state(F.col("state")) | F.col("state").isNull())


def row_documents(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Each row as one JSON document, arrays flattened to ``name_0``, ``name_1``, …

    ``widths`` gives the declared length of each array column.
    """
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            columns += [
                F.get(F.col(field.name), i).alias(f"{field.name}_{i}")
                for i in range(widths[field.name])
            ]
        else:
            columns.append(F.col(field.name))
    return df.withColumn("document", F.to_json(F.struct(*columns)))
