"""Problem 4: one ranking from channels of scores on different scales.

Leximin. In each request and channel a score becomes a percentile: the share of the request's other
items it beats (ties count half); an item that lacks the channel gets 0 there. An item's own vector holds its percentiles,
each raised to the power weight / greatest weight of the request, the way in which weights enter a minimum of grades: a channel of
weight 0 is 1 for all and takes nothing, a lighter one is pulled towards 1. The vector is sorted ascending and vectors are compared entry by entry, so an item
is first judged by where it is weakest and no strong channel hides a weak one. Only the order of the scores
counts, never their range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.session import cut_lineage

BLOCK = 100_000  # rows of a request that are ordered in one task


def _ordered(rows: DataFrame, group: list[str], order: list[Column], keep: list[str], amount: Column, name: str, parts: int) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over the rows before, in ``order`` within ``group``; groups of any size.

    The rows are dealt out in order of group and ``order``; a part knows what is before a row in it, and what
    the parts before it hold of the same group is a row a part and group.
    """
    dealt = rows.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt, "rank-dealt")
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "_part").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    here = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return dealt.withColumn("_here", here).join(sums, [*group, "_part"]).select(*keep, (F.col("_here") + F.col("_before")).alias(name))


def _percentiles(wide: DataFrame, keys: list[str], item: str, n: int) -> DataFrame:
    """``wide`` with ``_p0`` .., the percentiles of ``_s0`` .. : windows over a request."""
    every = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    for i in range(n):
        score = F.col(f"_s{i}")
        # nulls, the items that lack the channel, come first
        below = F.rank().over(Window.partitionBy(*keys).orderBy(score.asc_nulls_first())) - 1
        same = F.count(F.lit(1)).over(Window.partitionBy(*keys, score))
        share = (below + (same - 1) / 2) / F.greatest(every - 1, F.lit(1))
        wide = wide.withColumn(f"_p{i}", F.when(score.isNull(), 0.0).otherwise(share))
    return wide


def _large_percentiles(wide: DataFrame, keys: list[str], item: str, n: int, parts: int) -> DataFrame:
    """The same for requests of any size."""
    wide = cut_lineage(wide, "rank-wide")
    every = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("_every"))
    for i in range(n):
        values = wide.groupBy(*keys, f"_s{i}").agg(F.count(F.lit(1)).alias("_same"))
        values = _ordered(values, keys, [F.col(f"_s{i}").asc_nulls_first()], [*keys, f"_s{i}", "_same"], F.col("_same"), "_below", parts)
        share = (F.col("_below") + (F.col("_same") - 1) / 2) / F.greatest(F.col("_every") - 1, F.lit(1))
        values = values.join(every, keys).select(*keys, F.col(f"_s{i}"), share.alias(f"_p{i}")).where(F.col(f"_s{i}").isNotNull())
        wide = wide.join(values, [*keys, f"_s{i}"], "left").withColumn(f"_p{i}", F.coalesce(f"_p{i}", F.lit(0.0)))
    return wide


def leximin(scores: DataFrame, weights: dict[str, Column], keys: list[str], item: str = "id", block: int = BLOCK) -> DataFrame:
    """(``keys``, ``item``, ``lexi``, ``rank``): rank 1 is the best item of a request.

    ``scores``: ``keys``, ``item``, ``channel``, ``score``, and what ``weights`` (a column for
    each channel, over the same rows and alike within a request) refer to. Null keys, null and
    NaN scores, null items and channels that aren't in ``weights`` are lacking; of repeated rows
    of an item the greatest score counts. Equal vectors: the smaller item first.

    Repeated rows are taken together before anything is shuffled, and by item, so that no request is hot there. A request
    of at most ``block`` items is ordered in one task; larger ones, if there are any, are dealt out by range.
    """
    names, n = list(weights), len(weights)
    spark = scores.sparkSession
    good = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col(item).isNotNull() & F.col("channel").isin(names))
    for k in keys:
        good = good.where(F.col(k).isNotNull())
    own = [F.max(F.when(F.col("channel") == c, F.col("score"))).alias(f"_s{i}") for i, c in enumerate(names)]
    heavy = [F.first(w.cast("double"), ignorenulls=True).alias(f"_w{i}") for i, w in enumerate(weights.values())]
    # one number: the most rows of a request
    most = good.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0

    def sorted_vector(rows: DataFrame) -> DataFrame:
        top = F.greatest(*(F.col(f"_w{i}") for i in range(n))) if n > 1 else F.col("_w0")
        # rounded, so that sums in another order don't decide
        grades = (F.round(F.pow(F.col(f"_p{i}"), F.when(top > 0, F.col(f"_w{i}") / top).otherwise(1.0)), 9) for i in range(n))
        return rows.select(*keys, item, F.array_sort(F.array(*grades)).alias("lexi"))

    order = [F.col("lexi").desc(), F.col(item)]
    if most <= block:
        # dealt out by request, so that all that follows needs no other shuffle
        wide = good.repartition(*keys).groupBy(*keys, item).agg(*own, *heavy)
        ranked = sorted_vector(_percentiles(wide, keys, item, n))
        return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    wide = good.groupBy(*keys, item).agg(*own, *heavy)
    sizes = wide.groupBy(*keys).count()
    small = wide.join(sizes.where(F.col("count") <= block), keys, "left_semi")
    large = wide.join(sizes.where(F.col("count") > block), keys, "left_semi")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * most // block))
    ranked = sorted_vector(_percentiles(small, keys, item, n)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    others = _ordered(sorted_vector(_large_percentiles(large, keys, item, n, parts)), keys, order, [*keys, item, "lexi"], F.lit(1), "_ahead", parts)
    return ranked.unionByName(others.select(*keys, item, "lexi", (F.col("_ahead") + 1).cast("int").alias("rank")))


def request_ranking(requests: DataFrame, matches: DataFrame) -> DataFrame:
    """The ranking of the items of each hybrid request whose ``alpha`` is null or in 0..1."""
    alpha = F.coalesce(F.col("alpha"), F.lit(0.5))
    asked = requests.where(F.col("hybrid") & (F.col("alpha").isNull() | (~F.isnan("alpha") & F.col("alpha").between(0, 1)))).select("query_id", alpha.alias("alpha"))
    rows = matches.select("query_id", "channel", "id", "score").join(asked, "query_id")
    rest = (1 - F.col("alpha")) / 2
    return leximin(rows, {"vector": F.col("alpha"), "bm25": rest, "rerank": rest}, ["query_id"])
