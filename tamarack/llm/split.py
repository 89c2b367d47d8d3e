"""Problem 2: cut long texts at natural boundaries, with overlap.

Between any two words lies a boundary with a strength: a blank line 5, a line end 4, the
end of a sentence 3, of a clause (; : and a spaced dash) 2, a comma 1, else 0. A piece
begins at word s and ends after word e, s + least <= e <= s + most. Of the cuts in that
window the strongest is taken, of equally strong ones the last; a sparse table of range
maxima over the strengths answers this in constant time. The next piece begins
``overlap`` words before the cut. What is left goes into the last piece once it fits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import SPACE

MOST, OVERLAP = 400, 40

_WORD = re.compile(f"[^{SPACE}]+")
_SENTENCE = re.compile(r"[.!?…。！？](?:[)\]»”’\"']*)$")
_CLAUSE = re.compile(r"(?:[;:]|[,;:.!?][)\]»”’\"']+|^[–—-])$")
_PIECES = "id string, piece int, text string, n_words int, boundary int"


def word_count(text: Column) -> Column:
    """Words of a text in the JVM."""
    return F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != ""))


def strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Strength of the boundary after each word; after the last one 6."""
    out = np.zeros(len(spans), np.int8)
    for i, (a, b) in enumerate(spans):
        if i + 1 == len(spans):
            out[i] = 6
            break
        gap = text[b : spans[i + 1][0]]
        lines = len(gap.splitlines()) if "\n" not in gap else gap.count("\n") + 1
        last = text[b - 1]
        if lines > 2:
            out[i] = 5
        elif lines == 2:
            out[i] = 4
        elif last.isalnum():
            continue
        elif last == ",":
            out[i] = 1
        elif _SENTENCE.search(text, max(a, b - 8), b):
            out[i] = 3
        elif _CLAUSE.search(text, a, b):
            out[i] = 2
    return out


class RangeMaximum:
    """The last position of the greatest value of a range, from tables of doubling ranges."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        # one number orders by value, then by position
        self.levels = [values.astype(np.int64) * n + np.arange(n)]
        size = 1
        while 2 * size <= n:
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-size], below[size:]))
            size *= 2
        self.n = n

    def __call__(self, lo: int, hi: int) -> int:
        """Over ``lo <= i < hi``."""
        level = (hi - lo).bit_length() - 1
        row = self.levels[level]
        return int(max(row[lo], row[hi - (1 << level)]) % self.n)


def cut(text: str, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(first character, end, words, strength of the cut) of the pieces, in order."""
    if most <= 0:
        raise ValueError("most must be above 0")
    overlap = max(0, min(overlap, most - 1))
    least = max(overlap + 1, most // 2)
    spans = [m.span() for m in _WORD.finditer(text)]
    n, start, out = len(spans), 0, []
    if not n:
        return []
    force = strengths(text, spans)
    best = RangeMaximum(force)
    while n - start > most:
        end = best(start + least - 1, start + most)
        out.append((spans[start][0], spans[end][1], end + 1 - start, int(force[end])))
        start = end + 1 - overlap
    out.append((spans[start][0], spans[-1][1], n - start, 6))
    return out


def pieces(texts: DataFrame, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(``id``, ``piece``, ``text``, ``n_words``, ``boundary``) of texts of more than ``most`` words.

    ``texts``: ``id``, ``text``; more columns are ignored. Pieces hold the text as it stands,
    white space inside included. Null, empty and short texts give no piece; repeated rows
    give their pieces each time. ``boundary`` is the strength of the cut after the piece
    (6: the end of the text).
    """
    if most <= 0:
        raise ValueError("most must be above 0")

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                rows += [(i, n, text[a:b], words, force) for n, (a, b, words, force) in enumerate(cut(text, most, overlap))]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], ["id", "piece", "text", "n_words", "boundary"])

    long = texts.select("id", "text").where(F.col("text").isNotNull() & (word_count(F.col("text")) > most))
    return long.mapInArrow(run, _PIECES)
