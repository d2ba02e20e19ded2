"""Which interval over a place comes first: places and intervals meet at blocks of powers of two, never pair by pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinktrace.storage import materialise


def first_over(places: DataFrame, intervals: DataFrame, keys: list[str], largest: bool = False) -> DataFrame:
    """For each place (keys, at) that lies in an interval (keys, low, high, rank, value) of its keys the value of least, or largest, rank: keys, at, value.

    Places and bounds are whole numbers from 0 on, both bounds included. An interval is cut into at most two blocks of each power of two, and of each
    block only the best interval is kept; a place looks at the one block of each size that holds it. So the rows are places and intervals times the
    number of sizes, however many intervals lie over one place.
    """
    pick = F.max_by if largest else F.min_by
    best = lambda df, *by: df.groupBy(*by).agg(pick(F.struct("rank", "value"), "rank").alias("__x"))
    known = intervals.where("low <= high AND rank IS NOT NULL").select(*keys, F.col("low").cast("long").alias("__l"), (F.col("high") + 2).cast("long").alias("__r"), "rank", "value")
    # The bounds are the places right outside, counted from 1 on; at each size up to where they are neighbours the block beside an even left one and an odd right one is taken.
    once = best(known, *keys, "__l", "__r").withColumn("size", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.expr("__l ^ __r"))) - 2)))
    at = once.select(*keys, "size", F.expr("shiftright(__l, size)").alias("__a"), F.expr("shiftright(__r, size)").alias("__b"), "__x.*").where("(__a ^ __b) > 1")
    sides = F.array(F.when(F.col("__a") % 2 == 0, F.col("__a") + 1), F.when(F.col("__b") % 2 == 1, F.col("__b") - 1))
    blocks = at.select(*keys, "size", F.explode(F.array_compact(sides)).alias("block"), "rank", "value")
    blocks = materialise(best(blocks, *keys, "size", "block"), "intervals")
    sizes = F.broadcast(blocks.select("size").distinct())  # some dozens at most
    looks = places.select(*keys, F.col("at").cast("long").alias("at")).distinct().crossJoin(sizes).withColumn("block", F.expr("shiftright(at + 1, size)"))
    met = looks.join(blocks, [*keys, "size", "block"]).select(*keys, "at", "__x.*")
    return best(met, *keys, "at").select(*keys, "at", F.col("__x.value").alias("value"))
