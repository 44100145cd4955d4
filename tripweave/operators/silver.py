"""Bronze to Silver weather and the label summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripweave.functions.labels import weather_label
from tripweave.functions.times import wall_clock
from tripweave.schemas import MIN_ARTICLE_LENGTH
from tripweave.operators.keyed import first_per_text


def bronze(rows: DataFrame, ingested_at: Column) -> DataFrame:
    """Raw rows stamped with one run time, so a rerun gives the same table."""
    return rows.withColumn("ingested_at", ingested_at)


def silver(rows: DataFrame, destination: Column, raw_time: str = "forecast_time_raw",
           code: str = "weather_code") -> DataFrame:
    """Typed time, destination and label; the raw time text is dropped."""
    return rows.withColumns({
        "forecast_time": wall_clock(F.col(raw_time)),
        "destination_name": destination,
        "weather_label": weather_label(F.col(code)),
    }).drop(raw_time)


def unreadable_times(rows: DataFrame, raw_time: str = "forecast_time_raw") -> DataFrame:
    """Bronze rows whose time text is no time; Silver has them with a NULL time."""
    return rows.filter(F.col(raw_time).isNotNull() & wall_clock(F.col(raw_time)).isNull())


def label_summary(rows: DataFrame, label: str = "weather_label",
                  temperature: str = "temperature_c") -> DataFrame:
    """Hours and mean temperature (one decimal) per label."""
    return rows.groupBy(label).agg(
        F.count("*").alias("hours"),
        F.round(F.avg(temperature), 1).alias("avg_temperature_c"),
    )


def distinct_articles(articles: DataFrame, row_id: str, title: str = "title", text: str = "text",
                      min_length: int = MIN_ARTICLE_LENGTH) -> DataFrame:
    """Articles longer than the limit, one per title: the one with the lowest id."""
    return first_per_text(articles.filter(F.length(text) > min_length), F.col(title), row_id)
