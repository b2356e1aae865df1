"""Contiguous shards of nearly equal bytes, with DataFrame functions only.

The rows, without their texts, are dealt into ranges of the order; each range gives its totals; prefix sums
over those few totals give every range its place, and a running sum inside each range gives every row
its place in the whole. The targets are equal cuts of the total. The driver gets the total and one row per shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewall.session import cut_lineage


def byte_size(text) -> F.Column:
    """UTF-8 bytes of the text plus one for the record's end; a null text has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], tie: str) -> DataFrame:
    """Adds, for each name of ``sums``, the sum of a column over all rows before this one in ``order``.

    Rows equal in all of ``order`` follow each other in an order fixed by ``tie``, a column that tells rows apart, so
    no value of the order, however frequent, has to lie in one range. The ranges are written to the
    checkpoint folder before the totals are taken: both passes see the same ranges, also after a lost
    executor. What meets in one task is one row per range.
    """
    keys = [*order, tie]
    ranged = cut_lineage(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_of_{name}") for name, c in sums.items()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "_range", *(F.coalesce(F.sum(f"_of_{name}").over(before), F.lit(0)).alias(f"_from_{name}") for name in sums)
    )
    inside = W.partitionBy("_range").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    run = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{name}") for name, c in sums.items()))
    placed = run.join(starts, "_range")
    return placed.select(*df.columns, *((F.col(f"_in_{name}") + F.col(f"_from_{name}")).alias(name) for name in sums))


def byte_shards(df: DataFrame, n_shards: int, key: str = "doc_id", size: str = "size") -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to n_shards - 1), ``slot`` (gapless from 0 in the shard) and ``first_byte``.

    The order is ``key`` (nulls first), then size; a row belongs to the shard in whose equal part
    of the total its middle byte lies, so a shard differs from the target by less than its two edge rows.
    A row of many targets leaves shards empty. ``size`` must be positive and not null. Repeated rows
    and repeated keys are rows of their own. Columns named shard, slot or first_byte are replaced.
    An empty table gives no row.
    """
    keep = [c for c in df.columns if c not in ("shard", "slot", "first_byte")]
    named = df.select(
        F.struct(*keep).alias("_row"), F.col(key).alias("_key"), F.col(size).cast("long").alias("_size"),
        F.lit(1).cast("long").alias("_one"), F.monotonically_increasing_id().alias("_tie"),
    )
    at = cut_lineage(prefix_sums(named, ["_key", "_size"], {"_before": "_size", "_rank": "_one"}, "_tie"))
    total = at.agg(F.sum("_size")).first()[0] or 1
    middle = (2 * F.col("_before") + F.col("_size")).cast("decimal(38,0)")
    shard = F.least(F.floor(middle * n_shards / (2 * total)), F.lit(n_shards - 1)).cast("int")
    sharded = at.withColumn("_shard", shard)
    first = {r["_shard"]: r["_first"] for r in sharded.groupBy("_shard").agg(F.min("_rank").alias("_first")).collect()}
    starts = F.array(*(F.lit(first.get(i, 0)).cast("long") for i in range(n_shards)))
    return sharded.select(
        "_row.*", F.col("_shard").alias("shard"), (F.col("_rank") - F.get(starts, F.col("_shard"))).alias("slot"),
        F.col("_before").alias("first_byte"),
    )
