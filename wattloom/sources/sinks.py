"""Result sinks: tables, JSON documents and the keyed result registry."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet or CSV; as many files as the frame has partitions."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


class ResultRegistry:
    """Named values and named row lists of one run (small by nature)."""

    def __init__(self, spark: SparkSession, stamp: str):
        self.spark, self.stamp = spark, stamp
        self.values: dict[str, Any] = {"run_stamp": stamp}
        self.tables: dict[str, DataFrame] = {}

    def set(self, key: str, value: Any) -> None:
        self.values[key] = value

    def update(self, values: dict[str, Any]) -> None:
        self.values.update(values)

    def add_rows(self, table: str, rows: DataFrame) -> None:
        """Append rows; columns missing on either side become NULL."""
        held = self.tables.get(table)
        self.tables[table] = rows if held is None else held.unionByName(rows, allowMissingColumns=True)

    def add_row(self, table: str, row: dict[str, Any]) -> None:
        self.add_rows(table, self.spark.createDataFrame([row]))

    def value_frame(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(k, json.dumps(v, default=str)) for k, v in self.values.items()], "key string, value string")

    def save(self, path: str) -> None:
        write_json_rows(self.value_frame(), f"{path}/values")
        for name, rows in self.tables.items():
            write_table(rows, f"{path}/tables/{name}", "csv")
