"""Articles to activities: names resolved in one join, document text composed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripweave.functions.text import document_text
from tripweave.operators.keyed import first_per_key, is_small


def _by_name(activities: DataFrame) -> DataFrame:
    """One activity per destination and name without letter case: the lowest id."""
    keyed = activities.select(
        F.lower("destination_name").alias("_place"), F.lower("name").alias("_name"),
        "activity_id", F.col("name").alias("activity"), "category", "description")
    return first_per_key(keyed, ["_place", "_name"], [F.col("activity_id").asc()])


def _keyed(articles: DataFrame, destination: str, name: str) -> DataFrame:
    return articles.withColumns({"_place": F.lower(destination), "_name": F.lower(name)})


def match_articles(articles: DataFrame, activities: DataFrame, destination: str = "destination_name",
                   name: str = "activity_name", text: str = "text") -> DataFrame:
    """Articles with their activity and the text to embed. Names are a narrow lookup: while it
    can be broadcast the texts stay where they lie."""
    names = _by_name(activities)
    joined = _keyed(articles, destination, name).join(
        F.broadcast(names) if is_small(names) else names, ["_place", "_name"])
    composed = document_text(F.col("activity"), F.col("category"), F.col("description"), F.col(text))
    return joined.select(*articles.columns, "activity_id", composed.alias("document_text"))


def unmatched_articles(articles: DataFrame, activities: DataFrame, destination: str = "destination_name",
                       name: str = "activity_name") -> DataFrame:
    """Articles whose activity does not exist. The text is not needed, so it is not read."""
    names = _by_name(activities).select("_place", "_name")
    return _keyed(articles, destination, name).join(
        F.broadcast(names) if is_small(names) else names, ["_place", "_name"], "left_anti"
    ).select(*articles.columns)
