"""Text functions as columns: folding, tokens, words, chunks."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: French words that are no search terms (fixed values). Compared after accents are stripped, so
#: the accented ones never match.
STOPWORDS = (
    "le la les de du des un une et ou en à a au aux ce ces cette cet il elle ils elles on nous vous je tu me te se ne pas plus "
    "son sa ses leur leurs mon ma mes ton ta tes notre nos votre vos que qui quoi dont où pour par avec dans sur sous entre "
    "est sont être avoir fait été mais donc car ni si tout tous toute toutes bien très aussi comme peut ont era sera "
    "l d n s c j y m qu"
).split()

#: The white space at which Python's ``str.split`` splits, for a Java regular expression (fixed value).
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"


@functools.lru_cache(maxsize=1)
def _fold_map() -> tuple[str, str]:
    """Characters of the BMP that decompose to one character and marks, and that character."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1 and base.isascii():
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents, in the JVM; composed and decomposed accents alike.

    A few compatibility characters that stand for several letters (ligatures) stay as they are;
    ``fold_exact`` takes these apart, too.
    """
    source, target = _fold_map()
    return F.translate(F.regexp_replace(F.lower(text), "\\p{M}+", ""), source, target)


@F.pandas_udf(T.StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """Lower case, decomposed (NFKD), combining marks dropped."""

    def one(s):
        if s is None or s != s:
            return None
        s = s.lower()
        return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    return text.map(one)


def tokens(text: Column, exact: bool = False) -> Column:
    """Search terms in order, with repetitions: runs of a-z of two letters or more that are no stop words."""
    plain = F.coalesce((fold_exact if exact else fold)(text), F.lit(""))
    found = F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0))
    stop = [w for w in STOPWORDS if re.fullmatch("[a-z]{2,}", w)]
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(stop))


def words(text: Column) -> Column:
    """The words of a text as ``str.split`` gives them."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def chunks(text: Column, max_words: int = 400, overlap: int = 40) -> Column:
    """Windows of ``max_words`` words, each sharing ``overlap`` with the one before; joined by one blank.

    The overlap is clamped to 0..max_words - 1; the last window is the first that reaches the end.
    """
    if max_words <= 0:
        raise ValueError("max_words must be > 0")
    step = max_words - max(0, min(overlap, max_words - 1))

    def windows(w: Column) -> Column:
        count = F.when(F.size(w) == 0, 0).when(F.size(w) <= max_words, 1).otherwise(1 + F.ceil((F.size(w) - max_words) / step)).cast("int")
        made = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(w, i * step + 1, max_words), " "))
        return F.when(count > 0, made).otherwise(F.array().cast("array<string>"))

    # as the only element of an array the words are found once, not again for each window
    return F.transform(F.array(words(text)), windows).getItem(0)
