"""Packing suggestions for all trips from their stored forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripweave import schemas


def catalogue(trips: DataFrame, snapshots: DataFrame,
              items: tuple = schemas.PACKING_CATALOGUE,
              risk_item: str = schemas.RAIN_RISK_ITEM) -> DataFrame:
    """Every catalogue item for every trip. The umbrella's reason names the highest rain
    probability, where a missing value counts as 0 and a trip without forecast has 0."""
    forecast = snapshots.groupBy("trip_id").agg(
        F.max(F.coalesce("precipitation_probability", F.lit(0))).alias("_rain"))
    listed = F.array(*[
        F.struct(F.lit(n).alias("item_no"), F.lit(item).alias("item_name"), F.lit(why).alias("reason"))
        for n, (item, why) in enumerate(items, 1)])
    risk = F.concat(
        F.col("_item.reason"), F.lit(" (maximum forecast risk: "),
        F.coalesce("_rain", F.lit(0)).cast("string"), F.lit("%)"))
    return (
        trips.select("trip_id").join(forecast, "trip_id", "left")
        .withColumn("_item", F.explode(listed))
        .select(
            "trip_id", "_item.item_no", "_item.item_name",
            F.when(F.col("_item.item_name") == risk_item, risk)
            .otherwise(F.col("_item.reason")).alias("reason"))
    )


def rules(trips: DataFrame, snapshots: DataFrame, rule_rows: tuple = schemas.PACKING_RULES) -> DataFrame:
    """The items whose rule holds: highest rain at or above the rule's limit, lowest
    temperature below the rule's limit. Missing values and trips without forecast turn a
    rule off; a rule without limits always holds."""
    forecast = snapshots.groupBy("trip_id").agg(
        F.max("precipitation_probability").alias("_rain"), F.min("temperature_c").alias("_cold"))
    listed = F.array(*[
        F.struct(
            F.lit(n).alias("item_no"), F.lit(item).alias("item_name"), F.lit(why).alias("reason"),
            F.lit(rain).cast("double").alias("rain"), F.lit(cold).cast("double").alias("cold"))
        for n, (item, why, rain, cold) in enumerate(rule_rows, 1)])
    holds = (F.col("_item.rain").isNull() | F.coalesce(F.col("_rain") >= F.col("_item.rain"), F.lit(False))) & (
        F.col("_item.cold").isNull() | F.coalesce(F.col("_cold") < F.col("_item.cold"), F.lit(False)))
    return (
        trips.select("trip_id").join(forecast, "trip_id", "left")
        .withColumn("_item", F.explode(listed)).filter(holds)
        .select("trip_id", "_item.item_no", "_item.item_name", "_item.reason")
    )
