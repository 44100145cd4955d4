"""Row export to JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tripweave.functions.times import iso_text


def json_ready(rows: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, decimals as doubles; other columns unchanged."""
    columns = []
    for field in rows.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = iso_text(column)
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return rows.select(*columns)


def rows_to_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text per row; NULL fields are written as null."""
    ready = json_ready(rows)
    return ready.select(F.to_json(F.struct(*ready.columns), {"ignoreNullFields": "false"}).alias(name))
