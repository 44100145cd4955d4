"""Connected components of a table of links, in rounds of joins on stored tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tripweave.llm.common import written


def _links(rows: DataFrame, left, right) -> DataFrame:
    """Links from the higher to the lower node, each once, none to itself."""
    pair = rows.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    return pair.filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node and component, the lowest node reachable, of every node that has a link.

    Alternates two star operations: every node ties its higher neighbours to its lowest one,
    then its lower neighbours and itself to the lowest. Only links change, a hot node sends
    one minimum per task, and joins with it can be split. Stops when a round changes nothing;
    each round reads and writes a table in the shared folder. Null nodes are left out; no
    links give no rows.
    """
    current = written(_links(links.filter(F.col(left).isNotNull() & F.col(right).isNotNull()),
                             F.col(left), F.col(right)), "links")
    state = _state(current)
    while state[0]:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _links(both.filter("v > u").join(lowest, "u"), F.col("v"), F.col("m"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionAll(
            low.select(F.col("a").alias("x"), F.col("m").alias("y")))
        current = written(_links(small, F.col("x"), F.col("y")), "links")
        before, state = state, _state(current)
        if before == state:
            break
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def union(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels of array positions with the given pairs joined; a label is the lowest position.

    Roots are hooked under lower roots and paths shortened until all pairs agree.
    """
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return labels
        left, right = left[apart], right[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels = shorter
