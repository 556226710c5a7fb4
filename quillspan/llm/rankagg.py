"""One ranking from several differently scaled scores: robust rank aggregation.

Per group, each score gives positions; positions over group size are normalised ranks, free of scale.
An item's sorted normalised ranks are held against uniform order statistics: the k-th smallest of m is
beta(k, m - k + 1) distributed by chance. The least of these probabilities, corrected for taking the
least of m, is the item's significance, by which items are ranked.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.joins import join_small
from quillspan.session import materialize

#: Groups above this many rows are ranked in several buckets of about so many rows, however many that makes.
GROUP_ROWS = 50_000


def order_of(score: str, item: str) -> list[Column]:
    """Sort key: the highest score first, null scores last, ties by item."""
    return [F.col(score).isNull(), -F.col(score), F.col(item)]


def order_statistics(ranks: list[Column]) -> list[Column]:
    """For each k the beta probability that the k-th smallest of m normalised ranks is by chance no larger than it is."""
    m = len(ranks)
    ordered = F.sort_array(F.array(*ranks))

    def at_most(k: int) -> Column:
        x = F.element_at(ordered, k)
        return reduce(lambda a, b: a + b, [comb(m, j) * F.pow(x, F.lit(j)) * F.pow(1 - x, F.lit(m - j)) for j in range(k, m + 1)])

    return [at_most(k) for k in range(1, m + 1)]


def beta_significance(ranks: list[Column]) -> Column:
    """The corrected least beta order-statistic probability of m normalised ranks."""
    each = order_statistics(ranks)
    least = each[0] if len(each) == 1 else F.least(*each)
    return F.least(F.lit(1.0), least * len(ranks))


def _significance(scores: list[str], n: Column) -> Column:
    """A missing score counts as the last rank."""
    return beta_significance([F.when(F.col(s).isNull(), F.lit(1.0)).otherwise(F.col(f"pos_{s}") / n) for s in scores])


def position_in_buckets(rows: DataFrame, group: list[str], order: list[Column], out: str, sizes: DataFrame, item: str, group_rows: int) -> DataFrame:
    """``out``: position (from 1) of each row in its group by ``order``, for groups too large for one task.

    ``sizes`` holds (group, n). A hashed sample of each group's rows, some eight a bucket, gives bucket
    boundaries; rows are ranked inside buckets and shifted by the buckets before. The boundaries decide
    only where the work is done.
    """
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    buckets = F.ceil(F.col("__n") / group_rows)
    known = join_small(rows, sizes.withColumnRenamed("n", "__n"), group, spread=[item])
    every = F.greatest(F.lit(1), F.floor(F.col("__n") / (8 * buckets)))
    sample = known.where(F.pmod(F.xxhash64(F.lit(7), F.col(item)), every) == 0)
    cut = sample.groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("keys"), F.first(buckets).cast("int").alias("b"))
    step = F.greatest(F.lit(1), F.floor(F.size("keys") / F.col("b"))).cast("int")
    cut = cut.select(*group, F.filter("keys", lambda _, i: (i > 0) & (i % step == 0)).alias("cuts"))
    placed = join_small(rows, cut, group, "left", spread=[item]).withColumn("__bucket", F.coalesce(F.size(F.filter("cuts", lambda c: c <= key)), F.lit(0))).drop("cuts")
    w = Window.partitionBy(*group, "__bucket")
    local = placed.withColumn(out, F.row_number().over(w.orderBy(*order)).cast("long"))
    before = placed.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("c"))
    before = before.select(*group, "__bucket", (F.sum("c").over(Window.partitionBy(*group).orderBy("__bucket")) - F.col("c")).alias("__before"))
    return local.join(before, [*group, "__bucket"]).withColumn(out, F.col(out) + F.col("__before")).drop("__bucket", "__before")


def rank_aggregate(cands: DataFrame, group: str, item: str, scores: list[str], *, final: bool = True, sizes: DataFrame | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(group, item, scores, n, pos_<score>..., significance[, position]) of distinct (group, item) rows.

    Positions count from 1, the highest score first, null scores last, ties by item; ``position`` goes by
    significance, then by the sum of positions, then by item. Rows with a null group or item are left
    out; other columns are dropped; no rows give no rows. ``sizes`` (group, n) may give an upper bound
    of the group sizes where one is cheaper to have than a count of ``cands``. Groups above
    ``group_rows`` rows are ranked in buckets.
    """
    rows = cands.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{item}`").isNotNull()).select(group, item, *scores)
    sizes = sizes if sizes is not None else rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(sizes.where(F.col("n") > group_rows).select(group), "hot-groups")
    names = [group, item, *scores, "n", *[f"pos_{s}" for s in scores], "significance", *(["position"] if final else [])]
    last = lambda: [F.col("significance"), reduce(lambda a, b: a + b, [F.col(f"pos_{s}") for s in scores]), F.col(item)]

    # Groups of bounded size: all positions from one shuffle.
    w = Window.partitionBy(group)
    cold = join_small(rows, hot, [group], "left_anti", spread=[item]).withColumn("n", F.count(F.lit(1)).over(w))
    for s in scores:
        cold = cold.withColumn(f"pos_{s}", F.row_number().over(w.orderBy(*order_of(s, item))).cast("long"))
    cold = cold.withColumn("significance", _significance(scores, F.col("n")))
    if final:
        cold = cold.withColumn("position", F.row_number().over(w.orderBy(*last())).cast("long"))
    if hot.isEmpty():
        return cold.select(*names)

    large = materialize(join_small(rows, hot, [group], "left_semi", spread=[item]), "hot-rows")
    exact = materialize(large.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "hot-sizes")
    for s in scores:
        large = position_in_buckets(large, [group], order_of(s, item), f"pos_{s}", exact, item, group_rows)
    large = join_small(large, exact, [group], spread=[item]).withColumn("significance", _significance(scores, F.col("n")))
    if final:
        large = materialize(large, "hot-ranked")
        large = position_in_buckets(large, [group], last(), "position", exact, item, group_rows)
    return cold.select(*names).unionByName(large.select(*names))
