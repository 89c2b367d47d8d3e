"""Problem 6: how characteristic a term is of a record.

Log-odds ratio of the record against the rest of the collection with an informative
Dirichlet prior: a term's prior count is its share of the collection times ``prior``; the
difference of the two log-odds is divided by its standard error, so the score is a
z-value. Common terms get little, rare ones used often much.

The texts are cut into terms once: one pass gives the terms of the records and, added up over many records before
anything is shuffled, the counts of the collection. A common term would bring the records that hold it to one task, so terms that make up
more than 1 / COMMON of all entries, of which there are fewer than COMMON, are looked up in a broadcast table; the others meet
their counts in a shuffle.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import plain_tokens
from tamarack.session import cut_lineage

PRIOR = 500.0
COMMON = 20_000
HELD = 400_000  # terms whose counts a task holds before it gives them out

_ROWS = "id string, term string, tf long, n long, df long"


def _terms(text: str) -> list[str]:
    return [t for t in plain_tokens(text) if len(t) > 1]


def term_rows(texts: DataFrame, least: int = 1) -> DataFrame:
    """One pass: (``id``, ``term``, ``tf``, ``n``) of terms of at least ``least`` occurrences in a record of ``n`` terms, ``df`` null;
    and counts of the collection (``term``, ``tf``, ``df``: occurrences, records), to be added up, ``n`` null.
    """

    def run(batches):
        cf, df = Counter(), Counter()

        def counts():
            terms = list(cf)
            return pa.RecordBatch.from_arrays([pa.nulls(len(terms), pa.string()), pa.array(terms, pa.string()), pa.array([cf[t] for t in terms], pa.int64()), pa.nulls(len(terms), pa.int64()), pa.array([df[t] for t in terms], pa.int64())], ["id", "term", "tf", "n", "df"])

        for batch in batches:
            ids, terms, tfs, ns = [], [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                found = _terms(text or "")
                own = Counter(found)
                cf.update(own)
                df.update(own.keys())
                for t, tf in own.items():
                    if tf >= least:
                        ids.append(i), terms.append(t), tfs.append(tf), ns.append(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(ns, pa.int64()), pa.nulls(len(ids), pa.int64())], ["id", "term", "tf", "n", "df"])
            if len(cf) > HELD:
                yield counts()
                cf.clear(), df.clear()
        yield counts()

    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, _ROWS)


def distinctive(texts: DataFrame, least: int = 1, prior: float = PRIOR, df_most: int | None = None) -> DataFrame:
    """(``id``, ``term``, ``tf``, ``df``, ``z``) of the terms of each record.

    ``texts``: ``id`` (unique), ``text``; more columns are ignored. Null and empty texts have
    no terms. ``least`` and ``df_most`` leave out terms that occur less often in the record, or in
    more records; the statistics are those of the whole collection all the same. A
    collection of one record has no rest: its scores are those against the prior alone.
    """
    found = cut_lineage(term_rows(texts, least), "distinct-terms")
    rows = found.where("n is not null").select("id", "term", "tf", "n")
    counts = found.where("n is null").groupBy("term").agg(F.sum("tf").alias("cf"), F.sum("df").alias("df"))
    every = F.broadcast(found.where("n is null").agg(F.sum("tf").alias("total"), F.sum("df").alias("entries")))  # one row
    if df_most is not None:
        counts = counts.where(F.col("df") <= df_most)
    counts = cut_lineage(counts.join(every, how="cross"), "distinct-counts")
    common = F.col("df") > F.col("entries") / COMMON  # holds for fewer than COMMON terms, as ``entries`` is the sum of ``df``
    frequent = F.broadcast(counts.where(common).drop("entries"))
    rest = rows.join(frequent.select("term"), "term", "left_anti").join(counts.where(~common).drop("entries"), "term")
    rows = rows.join(frequent, "term").unionByName(rest)
    a = F.col("cf") * prior / F.col("total")
    inside, others = F.col("tf") + a, F.col("cf") - F.col("tf") + a
    odds = F.log(inside / (F.col("n") + prior - inside)) - F.log(others / (F.col("total") - F.col("n") + prior - others))
    return rows.select("id", "term", "tf", "df", (odds / F.sqrt(1 / inside + 1 / others)).alias("z"))
