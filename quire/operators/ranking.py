"""Exact running totals and ranks by range-partitioned sorting.

A window over a group puts the whole group into one task. Here rows are range
partitioned by (group, order), so a group that holds a third of all rows spreads
over many tasks; each partition sums its own part and the parts before it come
in as offsets from a table with one row per (partition, group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

_PART = "_range_part"


def running_totals(df: DataFrame, groups: list[str], order: list[str], amount: str, total: str, before: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``total``: the sum of ``amount`` over the rows of the group up to this one.

    Rows with equal ``order`` are peers and get the same total (SQL's RANGE
    frame). ``before`` names a second column with the total of the rows that
    sort strictly before the peers. Nulls sort first, as in Spark. A null amount
    counts as 0; an empty table gives an empty table.
    """
    keys = [*groups, *order]
    amt = F.coalesce(F.col(amount), F.lit(0))
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    spread = cut_lineage(spread.withColumn(_PART, F.spark_partition_id()))
    parts = spread.groupBy(*groups, _PART).agg(F.sum(amt).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*groups, _PART, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    here = Window.partitionBy(*groups, _PART).orderBy(*order)
    local = spread.withColumn("_local", F.sum(amt).over(here))
    local = local.withColumn("_peers", F.sum(amt).over(Window.partitionBy(*groups, _PART, *order)))
    joined = local.alias("l").join(offsets.alias("o"), F.expr(" and ".join([f"l.`{c}` <=> o.`{c}`" for c in [*groups, _PART]])))
    cols = [F.col(f"l.`{c}`") for c in df.columns]
    out = [(F.col("_offset") + F.col("_local")).alias(total)]
    if before:
        out.append((F.col("_offset") + F.col("_local") - F.col("_peers")).alias(before))
    return joined.select(*cols, *out)


def exact_ranks(df: DataFrame, groups: list[str], value: str, weight: str, below: str = "n_below", at_or_below: str = "n_at_or_below", n: str = "n_group") -> DataFrame:
    """Distinct ``value`` per group with its exact counts below, at or below, and in the group.

    ``weight`` is the number of rows a value stands for, so callers aggregate
    before the shuffle. Null values are a value of their own that sorts first.
    """
    one = df.groupBy(*groups, value).agg(F.sum(weight).alias("_w"))
    run = running_totals(one, groups, [value], "_w", at_or_below, below)
    size = one.groupBy(*groups).agg(F.sum("_w").alias(n))
    cond = F.expr(" and ".join(f"r.`{c}` <=> s.`{c}`" for c in groups)) if groups else F.lit(True)
    return run.alias("r").join(size.alias("s"), cond).select(*[F.col(f"r.`{c}`") for c in [*groups, value, at_or_below, below]], F.col(f"s.`{n}`"))


def running_maxima(df: DataFrame, groups: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Add, for each (new column -> value column), the maximum over the rows of the group strictly before this one.

    ``order`` must be unique in a group. As running_totals, no task holds more
    than a range; the maxima of earlier ranges come in as offsets.
    """
    keys = [*groups, *order]
    spread = cut_lineage(df.repartitionByRange(*keys).withColumn(_PART, F.spark_partition_id()))
    parts = spread.groupBy(*groups, _PART).agg(*[F.max(v).alias(f"_m_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*groups, _PART, *[F.max(f"_m_{n}").over(earlier).alias(f"_o_{n}") for n in values])
    here = Window.partitionBy(*groups, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = spread.select("*", *[F.max(v).over(here).alias(f"_l_{n}") for n, v in values.items()])
    joined = local.alias("l").join(offsets.alias("o"), F.expr(" and ".join([f"l.`{c}` <=> o.`{c}`" for c in [*groups, _PART]])))
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], *[F.greatest(F.col(f"_o_{n}"), F.col(f"_l_{n}")).alias(n) for n in values])
