"""JSON and CSV output. Every writer is a distributed Spark write; nothing is collected."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, functions as F, types as T

from ..vocab import DEFAULT

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def iso_dates(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text; nulls stay null."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, _DATES)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def json_export(df: DataFrame, path: str) -> None:
    iso_dates(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def dashboard_export(results: Mapping[str, DataFrame], path: str, exported_at: object,
                     start: object = DEFAULT.report_start, at_once: int = 4) -> list[str]:
    """Write each named result as JSON lines below ``path``, plus ``meta`` with the two dates.

    Returns the folders written. A few writes run side by side so that small reports do not
    leave the cluster idle behind the last task of a large one.
    """
    spark = next(iter(results.values())).sparkSession
    meta = spark.range(1).select(
        F.lit(str(exported_at)).alias("exportedAt"), F.lit(str(start)).alias("dashboardStart"))
    frames = {**results, "meta": meta}
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        list(pool.map(lambda item: json_export(item[1], f"{path}/{item[0]}"), frames.items()))
    return [f"{path}/{name}" for name in frames]


def csv_export(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with a header. Each part is a complete file: its header starts with the byte-order
    mark that makes spreadsheet programs read it as UTF-8."""
    out = iso_dates(df)
    if bom:
        first = out.columns[0]
        out = out.withColumnRenamed(first, "\ufeff" + first)
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option(
        "escape", '"').csv(path)
