"""The package's functions by name in Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tamarack.functions.text import STOPWORDS, fold_exact


def register(spark: SparkSession, dimension: int = 256) -> list[str]:
    """``fold_exact(text)``, ``search_terms(folded text)``, ``extract_text(content, filename)``, ``hash_embed(text)``."""
    from tamarack.sources.embed import embed_column
    from tamarack.sources.extract import extract_column

    spark.udf.register("fold_exact", fold_exact)
    spark.udf.register("extract_text", extract_column)
    spark.udf.register("hash_embed", embed_column("hash", dimension=dimension))
    stop = ", ".join(f"'{w}'" for w in STOPWORDS if w.isascii() and len(w) > 1)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION search_terms(plain STRING) RETURNS ARRAY<STRING>
        RETURN filter(regexp_extract_all(coalesce(plain, ''), '[a-z]+', 0), t -> length(t) > 1 AND t NOT IN ({stop}))""")
    return ["fold_exact", "search_terms", "extract_text", "hash_embed"]
