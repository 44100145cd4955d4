"""Classification columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weather-code bands, inclusive. Other codes and NULL are "other".
LABEL_BANDS = (("clear", 0, 0), ("cloudy", 1, 3), ("rain", 51, 67))


def weather_label(code: Column) -> Column:
    label = F.lit("other")
    for name, low, high in LABEL_BANDS:
        label = F.when(code.between(low, high), name).otherwise(label)
    return label


def preference_order(indoor: Column, category: Column, preferred: tuple[str, ...]) -> list[Column]:
    """Sort keys: outdoor first, then the preferred categories."""
    return [indoor.cast("int").asc(), F.when(category.isin(*preferred), 0).otherwise(1).asc()]
