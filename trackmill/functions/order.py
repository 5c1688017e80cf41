"""Exact order statistics of groups of any size, by counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.sources.tables import materialise

#: Stretches between a group's least and largest value that are counted first.
STRETCHES = 1024


def placed(rows: DataFrame, key: str, value: str, places: DataFrame) -> DataFrame:
    """(key, name, value): for each row (key, name, place) of places, the value at this place (from 0) of the key's
    sorted values.

    Equal values are counted, and these counts by stretch, so that a running sum over at most STRETCHES
    rows a key finds the stretch that holds a place; only that stretch's values are sorted. No task gets all values
    of a key, unless most of its different values lie in one stretch. Nulls and places out of range give no row.
    """
    n, _ = materialise(rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    ends = n.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    stretch = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * STRETCHES), F.lit(STRETCHES - 1))).otherwise(F.lit(0)).cast("int")
    dealt = n.join(ends, key).select(key, "v", "n", stretch.alias("s"))
    coarse = dealt.groupBy(key, "s").agg(F.sum("n").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(key).orderBy("s"))
    coarse = coarse.withColumn("before", upto - F.col("m"))
    asked = places.join(coarse, key).where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("m")))
    few = dealt.join(asked.select(key, "s", "before").distinct(), [key, "s"])
    first = F.col("before") + F.sum("n").over(Window.partitionBy(key, "s").orderBy("v")) - F.col("n")
    few = few.withColumn("first", first).select(key, "s", "v", "n", "first")
    found = asked.select(key, "name", "place", "s").join(few, [key, "s"]).where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n")))
    return found.select(key, "name", F.col("v").alias("value"))
