"""What the operators of this folder share: tables, live records, texts."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.session import spread

#: Any Unicode white space, as ``str.split`` knows it (fixed values).
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"

_MARKS = re.compile("[̀-ͯ]")
_ALPHA = re.compile("[a-z]+")
_ALNUM = re.compile("[a-z0-9]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "vectors") else rows


def live(vectors: DataFrame, *columns: str | Column) -> DataFrame:
    """The row with the greatest ``seq`` of each ``id``, with ``columns`` of it.

    One shuffle; before it each partition keeps only its own latest row of an id
    (a limit pushed below the exchange), so an id with very many rows stays cheap.
    Rows without ``id`` or ``seq`` aren't records; of rows equal in both one is kept.
    """
    rows = vectors.where(F.col("id").isNotNull() & F.col("seq").isNotNull()).select("id", "seq", *columns)
    latest = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "seq")


def string_field(metadata: str | Column, key: str) -> Column:
    """``key`` of a JSON object if it is a string there, else null (also if it doesn't parse)."""
    one = F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(one) == "STRING", F.try_variant_get(one, "$", "string"))


def live_texts(vectors: DataFrame, *columns: str | Column) -> DataFrame:
    """(``id``, ``text``, ``columns``) of the live records that have text."""
    return live(vectors, string_field("metadata", "text").alias("text"), *columns).where(F.col("text").isNotNull())


def plain_text(text: str) -> str:
    """Lower case, decomposed, without combining marks."""
    text = text.lower()
    if text.isascii():
        return text
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    if text.isascii():
        return text
    return "".join(c for c in text if not unicodedata.combining(c))


def plain_tokens(text: str, digits: bool = False) -> list[str]:
    """The longest runs of ``a-z`` (with ``digits`` of ``a-z0-9``) of the plain text."""
    return (_ALNUM if digits else _ALPHA).findall(plain_text(text))
