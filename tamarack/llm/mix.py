"""Problem 9: mix sources to target shares of all tokens.

Tokens are added up for each source, each source gets a rate, and a document is given
out floor(rate) times, plus once more with probability rate - floor(rate), decided by a
hash of seed and document, so any run gives the same set.

The size of the mixture: ``total`` tokens, or, where none is given, the most tokens at which
no listed source with tokens needs a rate above its ``max_repeats``, so that every share
is met. With a ``total`` beyond that, short sources stay at their cap and the others
share what is missing in proportion to their targets, as far as their own caps allow
(the level at which sum(min(cap, level * share)) reaches the total).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 20


def source_rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(``source``, ``target_share``, ``max_repeats``, ``tokens``, ``rate``), one row a source of either table.

    ``sizes``: ``source``, ``tokens``. A source that isn't listed, has a null or negative share,
    or no tokens has rate 0. A null or negative ``max_repeats`` counts as 0. Shares are taken
    relative to the sum over the listed sources that have tokens.
    """
    listed = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = sizes.join(listed, sizes["source"].eqNullSafe(listed["source"]), "full").select(F.coalesce(sizes["source"], listed["source"]).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    share = F.when((F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(0.0)
    rows = rows.withColumn("share", share).withColumn("cap", F.when(F.col("share") > 0, F.col("tokens") * F.col("max_repeats")).otherwise(0.0))
    # a source reaches its cap at level cap / share; sources in that order
    rows = rows.withColumn("at", F.when(F.col("share") > 0, F.col("cap") / F.col("share")))
    # a window over all sources: one row each, already aggregated
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("at").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    if total is None:
        rows = rows.withColumn("level", F.min("at").over(whole))
    else:
        rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(order), F.lit(0.0))).withColumn("open", F.sum("share").over(whole) - F.coalesce(F.sum("share").over(order), F.lit(0.0)))
        # what a level gives is concave in it, and these lines lie above it: the greatest of their levels is right
        level = F.max(F.when(F.col("share") > 0, (F.lit(float(total)) - F.col("capped")) / F.col("open"))).over(whole)
        rows = rows.withColumn("level", level)
    rate = F.when(F.col("share") > 0, F.least(F.col("cap"), F.col("level") * F.col("share")) / F.col("tokens")).otherwise(0.0)
    return rows.select("source", "target_share", "max_repeats", "tokens", rate.alias("rate"))


def mixture(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """(``doc_id``, ``source``, ``n_tokens``, ``copies``): the documents of the mixture, copies above 0.

    ``sized``: ``doc_id``, ``source``, ``n_tokens``; more columns are ignored. A null source is a
    source that isn't listed. Empty documents cost nothing and follow their source's rate.
    """
    sized = sized.select("doc_id", "source", "n_tokens")
    rates = source_rates(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), targets, total)
    rates = rates.where("rate > 0").select("source", "rate")
    # few rows: one for each listed source, never more than `targets` has
    rows = sized.join(rates, "source")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    whole = F.floor("rate")
    copies = (whole + (draw < F.col("rate") - whole).cast("int")).cast("int")
    return rows.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def reached(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """(``source``, ``target_share``, ``max_repeats``, ``tokens``, ``rate``, ``given_tokens``, ``reached_share``), a row for each source."""
    rates = source_rates(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), targets, total)
    given = mixture(sized, targets, total, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("given_tokens"))
    rows = rates.join(given.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("given_tokens", F.coalesce("given_tokens", F.lit(0)))
    every = F.sum("given_tokens").over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("reached_share", F.when(every > 0, F.col("given_tokens") / every).otherwise(0.0))
