"""The queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import distinct, encode, knn, language, mix, neardup, pii, rank, split, truncate
from tamarack.llm.common import live_texts, string_field, table
from tamarack.session import cut_lineage


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.neighbour_pairs(knn.nearest(knn.usable(table(spark, sf_dir, "vectors"))))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.pieces(live_texts(table(spark, sf_dir, "vectors")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece = 0").select("id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.finder(spark, table(spark, sf_dir, "name_parts"))
    return pii.mentions(live_texts(table(spark, sf_dir, "vectors")), found).select("id", "kind", "surface").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.finder(spark, table(spark, sf_dir, "name_parts"))
    return pii.redacted(live_texts(table(spark, sf_dir, "vectors")), found)


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank.request_ranking(table(spark, sf_dir, "query_requests"), table(spark, sf_dir, "query_matches"))
    return ranked.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_ranking(spark, sf_dir).where("rank = 1").select("query_id", "id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs(live_texts(table(spark, sf_dir, "vectors")))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(live_texts(table(spark, sf_dir, "vectors")))


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinctive(live_texts(table(spark, sf_dir, "vectors")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = distinct.distinctive(live_texts(table(spark, sf_dir, "vectors")), least=4, df_most=5)
    return marked.where("z > 0").select("id", "term")


def _language_model(vectors: DataFrame) -> language.Model:
    labelled = vectors.select("id", string_field("metadata", "text").alias("text"), string_field("metadata", "lang").alias("lang"))
    return language.train(labelled, rows=vectors.count())


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "vectors")
    return language.identify(live_texts(vectors), _language_model(vectors))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "vectors")
    texts = live_texts(vectors, string_field("metadata", "lang").alias("label"))
    return language.relabel(texts, _language_model(vectors)).select("id", "lang")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.token_ids(table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = encode.token_ids(table(spark, sf_dir, "documents"), count=True, carry=["source"])
    return cut_lineage(counts, "mix-sizes")  # read twice, encoded once


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixture(_sized(spark, sf_dir), table(spark, sf_dir, "source_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.reached(_sized(spark, sf_dir), table(spark, sf_dir, "source_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncate.truncated(table(spark, sf_dir, "documents")).select("doc_id")


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncate.source_rates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_LIVE = """
live AS (SELECT id, metadata FROM vectors WHERE id IS NOT NULL AND seq IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
texts AS (SELECT id, metadata::JSON ->> '$.text' AS text FROM live
          WHERE CASE WHEN json_valid(metadata) THEN json_type(metadata::JSON, '$.text') = 'VARCHAR' ELSE false END)"""


def oracle_sql() -> dict[str, str]:
    ranking = """
WITH asked AS (SELECT query_id, coalesce(alpha, 0.5) AS alpha FROM query_requests
               WHERE hybrid AND (alpha IS NULL OR (NOT isnan(alpha) AND alpha BETWEEN 0 AND 1))),
scored AS (SELECT query_id, id, max(score) FILTER (channel = 'vector') AS v, max(score) FILTER (channel = 'bm25') AS b,
                  max(score) FILTER (channel = 'rerank') AS r
           FROM query_matches WHERE score IS NOT NULL AND NOT isnan(score) AND id IS NOT NULL
             AND channel IN ('vector', 'bm25', 'rerank') GROUP BY query_id, id),
shares AS (SELECT query_id, id, alpha, (1 - alpha) / 2 AS rest, {shares} FROM scored JOIN asked USING (query_id)),
own AS (SELECT query_id, id, list_sort([round(pow(pv, alpha / greatest(alpha, rest)), 9), round(pow(pb, rest / greatest(alpha, rest)), 9),
                                        round(pow(pr, rest / greatest(alpha, rest)), 9)]) AS lexi FROM shares),
ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY lexi[1] DESC, lexi[2] DESC, lexi[3] DESC, id) AS rank FROM own)
SELECT {columns} FROM ranked {where}"""
    share = "CASE WHEN {c} IS NULL THEN 0.0::DOUBLE ELSE (rank() OVER (PARTITION BY query_id ORDER BY {c} ASC NULLS FIRST) - 1 + (count(*) OVER (PARTITION BY query_id, {c}) - 1) / 2.0::DOUBLE) / greatest(count(*) OVER (PARTITION BY query_id) - 1, 1) END AS p{c}"
    shares = ", ".join(share.format(c=c) for c in "vbr")
    return {
        "p1_found": """
WITH live AS (SELECT id, index_name, vector FROM vectors WHERE id IS NOT NULL AND seq IS NOT NULL AND index_name IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
good AS (SELECT id, index_name, vector::DOUBLE[] AS v FROM live WHERE len(vector) = 64
           AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_inner_product(vector::DOUBLE[], vector::DOUBLE[]) > 0),
units AS (SELECT id, index_name, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM good),
near AS (SELECT a.id AS id, b.id AS other FROM units a JOIN units b ON a.index_name = b.index_name AND a.id <> b.id
         QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.u, b.u), 12) DESC, b.id) <= 5)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM near""",
        "p2_found": f"WITH {_LIVE} SELECT id FROM texts WHERE len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '')) > 400",
        "p4_ranking": ranking.format(shares=shares, columns="query_id, id, rank", where=""),
        "p4_found": ranking.format(shares=shares, columns="query_id, id", where="WHERE rank = 1"),
        "p5_found": f"""
WITH {_LIVE},
long AS (SELECT id, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+') AS t FROM texts
         WHERE len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '')) >= 20),
runs AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS run FROM long),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM shared JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE shared.n >= 0.5 * (x.n + y.n - shared.n)""",
        "p6_found": f"""
WITH {_LIVE},
terms AS (SELECT id, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z]+')) AS term FROM texts),
counts AS (SELECT id, term, count(*) AS tf FROM terms WHERE length(term) > 1 GROUP BY id, term),
spread AS (SELECT term, count(*) AS df FROM counts GROUP BY term)
SELECT id, term FROM counts JOIN spread USING (term) WHERE tf >= 4 AND df <= 5""",
    }
