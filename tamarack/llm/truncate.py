"""Problem 10: texts that were cut, and how often each source cuts.

Two kinds of evidence, the first that speaks decides.

Near-copies, for every text. A cut copy resembles the beginning of the longer one, however much was lost, so the
min-hashes are taken of beginnings: of the first 4, 16, 64 .. runs of five words. A text's longest such window meets the
same window of all others (``BANDS`` bands of ``ROWS`` hashes: two windows of a similarity of 0.8 meet with 0.97). Of texts
that meet, a longer one is a partner if it holds the text's last three whole words with more behind them. There the end
is aligned: if the longer one goes on in the same word, or in the same line without a sentence end between, it tells a
cut; a stop is no sentence end where it goes on in lower case or behind an abbreviation. If the longer one ends its
sentence or line there, it tells that the text is whole. Partners that tell a cut are verified, ``ROUND`` at first and
four times as many in each further round, until one is right or none is left: 0.8 of the text's runs must be in the
longer one. Then so are, for the texts still open, those that tell a whole end.

Closing words, for texts without such a copy. The closing word is the last word with the signs attached to it, in its place: in a
code block, item, heading, row (with all its fields or not), or so many words into a line. Its terminality is how
often, over all texts, a line ends so, against how often a text cut at any character would: ``resolution`` in running text
closes nothing, ``resolution.`` does, ``Art.`` doesn't, and ``resol`` is only ever the beginning of a word. Words seen
seldom lean on their place and signs. A terminality below ``terminal`` times the one of all characters is a cut. Ends of texts that are
cuts themselves are taken out of the counts and all is counted again.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 5, 3, 5
FIRST, STEP = 4, 4  # the first window, and the next in relation to it
TAIL = 3
ROUND = 8  # partners that are verified at first
TERMINAL = 1.0
LEAN, LEAN_PLACE = 5.0, 50.0  # the rate of a word leans on its place's as on so many characters, that one on the rate of its signs
LONG = 40  # words of more letters count as one and the same word
PASSES = 2
SALT = 16

_END = re.compile(r"[.!?。！？؟]['’\"”»)\]]*$")
_OMITTED = re.compile(r"(?:\s*(?:\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|…|\.\.\.))+$")
_ITEM = re.compile(r"\s*(?:[-*•–·▪‣◦]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s")
_HEADING = re.compile(r"\s*(?:#{1,6}\s|\*\*|__|§\s*\d|\d+(?:\.\d+)*\.?\s+\S)")
_MARKER = re.compile(r"(?:\(?\d{1,3}|\(?[a-z])[.)]$")
_DIGITS = re.compile(r"\d+")
#: Abbreviations that don't end a sentence, without their stop (fixed values).
_SHORT = frozenset(
    "art arts abs al lit nr no nos num núm dr dra prof mr mrs ms mme st ste hr fr sr sra sig dott avv ing mag bzw ca vgl ziff bd pp cf tel fig "
    "z.b z. d.h d. u.a u. e.g i.e p.ex p.es p.ej".split()
)
_MONTH = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")
_INVISIBLE = "​‌‍⁠﻿­"
_SIGNS = {c: kind for kind, signs in {"S": ".!?。！？؟", "C": ")]}»”\"", "A": "'’", ",": ",;:", "(": "([{«“„", "%": "%€$£°", "-": "-–—/&"}.items() for c in signs}
_OPEN = "(block)"


def _stripped(text: str) -> str:
    return text.rstrip().rstrip(_INVISIBLE).rstrip()


def _without_signs(text: str) -> str:
    """Without pictures and other symbols at the end."""
    n = len(text)
    while n and (unicodedata.category(text[n - 1]) in ("So", "Sk", "Cf", "Mn") or text[n - 1].isspace()) and text[n - 1] not in "�`":
        n -= 1
    return text[:n]


def _without_first_signs(text: str) -> str:
    """``_without_signs`` at the beginning; a blank stays for what is taken off."""
    return " " + _without_signs(text[::-1])[::-1]


def body(text: str | None) -> str:
    """``text`` without what may stand behind a cut or an end: white space, symbols, marks of omission, broken characters."""
    s = _stripped(text or "")
    while True:
        t = _without_signs(s.rstrip("�"))
        if t[-1:] in ("…", ".", "]", ")"):
            n = len(t)
            while n and not t[n - 1].isalnum():
                n -= 1
            omitted = _OMITTED.search(t, n)
            if omitted and omitted.start() and t[omitted.start() - 1] != ".":
                t = t[: omitted.start()]
        t = _stripped(t)
        if t == s:
            return s
        s = t


# closing words --------------------------------------------------------------------------


def places(line: str, before: str) -> list[tuple[str, list[str]]]:
    """(place, words) of the words of a line outside code; ``before``: the line above, empty at the top of a paragraph."""
    words = line.split()
    if "|" in line or "|" in before:
        out, fields, need = [], line.split("|"), before.count("|")
        for i, field in enumerate(fields):
            inside = field.split() + ["|"] * (i < len(fields) - 1)
            out.append(("row" if i + (i < len(fields) - 1 and not field.split()) >= need else "row short", inside))
        return [o for o in out if o[1]]
    if _ITEM.match(line):
        return [("item", words)]
    if _HEADING.match(line):
        return [("heading", words)]
    named = 0
    while named < len(words) and (words[named][0].isupper() or not words[named][0].isalpha()):
        named += 1
    out = []
    for lo, hi in ((0, 1), (1, 2), (2, 3), (3, 6), (6, 9), (9, len(words))):
        if lo >= len(words):
            break
        cut = min(max(named, lo), hi)
        out += [(f"name {lo}", words[lo:cut]), (f"line {lo}", words[cut:hi])]
    return [o for o in out if o[1]]


def lines_of(text: str):
    """(places and words, whether the line is one) of each line of ``text``; nothing in an open code block ends."""
    above, block = "", False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            block = not block
            yield [(_OPEN if block else "fence", line.split())], not block
            above = ""
        elif not line.strip():
            above = ""
        else:
            yield ([(_OPEN, line.split())] if block else places(line, above)), not block
            above = line


def closing(word: str) -> tuple[str, str]:
    """(the word itself in lower case, what kinds of signs are attached to its end)."""
    n = len(word)
    while n and not word[n - 1].isalnum():
        n -= 1
    if n == len(word) - 1 and word[n] in "'’" and word[0].isalnum():
        n += 1  # an elision is the beginning of a word
    signs = "".join(_SIGNS.get(c, "o") for c in word[n:][-2:])
    core = "://" if "://" in word else _DIGITS.sub("0", word[:n]).lower()
    return (core if len(core) <= LONG else "…"), signs


class Positions:
    """Counts over texts: of (place, word) how often it is written, how often it closes a line and how often a text."""

    def __init__(self):
        self.seen, self.ends, self.last = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)

    def add(self, text: str) -> tuple[str, str, str] | None:
        """Count a text's ``body``; the place, word and signs of its closing word."""
        end, told = None, False
        for parts, line in lines_of(text):
            for place, words in parts:
                self.seen[place].update(words)
            if end and told:
                self.ends[end[0]][end[1]] += 1
            end, told = (parts[-1][0], parts[-1][1][-1]), line
        if end is None:
            return None
        if told:
            self.last[end[0]][end[1]] += 1
        return end[0], *closing(end[1])

    def large(self) -> bool:
        return sum(map(len, self.seen.values())) > 300_000

    def rows(self) -> list[tuple]:
        """(place, word, signs, seen, ends, last), added up after words are made alike."""
        out: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])
        for k, counts in enumerate((self.seen, self.ends, self.last)):
            for place, words in counts.items():
                for word, n in words.items():
                    out[place, *closing(word)][k] += n
        return [(*key, *n) for key, n in out.items()]


_KEY = ["place", "core", "signs"]


def terminality(counts: DataFrame, passes: int = PASSES) -> DataFrame:
    """(``place``, ``core``, ``signs``, ``terminality``) of the closing words of texts; 1: ends as often as any character.

    ``counts``: the key, ``seen``, ``ends``, ``last``. One text's own end is left out of what is said of it.
    """
    counts = cut_lineage(counts.groupBy(*_KEY).agg(*(F.sum(c).alias(c) for c in ("seen", "ends", "last"))), "truncate-counts")
    asked = counts.where("last > 0").select(*_KEY)
    # a text cut at any character: each word is met as each of its beginnings, too
    short = F.sequence(F.lit(1), F.length("core"))
    begun = counts.where("core <> ''").select("place", F.explode(F.transform(short, lambda n: F.substring("core", F.lit(1), n))).alias("core"), F.lit("").alias("signs"), "seen")
    whole = counts.where("signs <> '' or core = ''").select(*_KEY, "seen")
    met = begun.unionByName(whole).join(asked, _KEY, "left_semi").groupBy(*_KEY).agg(F.sum("seen").alias("met"))
    # of places and signs there are some hundred
    size = F.when((F.col("signs") != "") | (F.col("core") == ""), F.col("seen")).otherwise(0)
    by_place = counts.select("place", "signs", size.alias("met"), "ends").unionByName(counts.select("place", F.lit("").alias("signs"), (F.col("seen") * F.length("core")).alias("met"), F.lit(0).alias("ends")))
    by_place = by_place.groupBy("place", "signs").agg(F.sum("met").alias("met_p"), F.sum("ends").alias("ends_p"))
    known = cut_lineage(counts.where("last > 0").join(met, _KEY), "truncate-words").withColumn("kept", F.col("last"))
    for n in range(passes):
        # ``kept``: the ends of texts that are no cuts so far
        kept = known.groupBy("place", "signs").agg(F.sum("kept").alias("kept_p"))
        rates = by_place.join(kept, ["place", "signs"], "left").withColumn("ends_p", F.col("ends_p") + F.coalesce("kept_p", F.lit(0))).drop("kept_p")
        signs = rates.where(F.col("place") != _OPEN).groupBy("signs").agg(F.sum("ends_p").alias("ends_s"), F.sum("met_p").alias("met_s"))
        every = rates.agg((F.sum("ends_p") / F.sum("met_p")).alias("every"))
        rows = known.join(rates, ["place", "signs"]).join(signs, "signs", "left").join(F.broadcast(every), how="cross")  # one row
        own = F.least(F.col("kept"), F.lit(1))

        def lean(ends: Column, met: Column, rate: Column, weight: float) -> Column:
            ends, met = F.coalesce(ends, F.lit(0)), F.coalesce(met, F.lit(0))
            return (F.greatest(ends - own, F.lit(0)) + weight * rate) / (F.greatest(met - own, F.lit(0)) + weight)

        place = lean(F.col("ends_p"), F.col("met_p"), lean(F.col("ends_s"), F.col("met_s"), F.col("every"), LEAN), LEAN_PLACE)
        value = lean(F.col("ends") + F.col("kept"), F.col("met"), place, LEAN) / F.col("every")
        rows = rows.withColumn("terminality", value)
        if n == passes - 1:
            return rows.select(*_KEY, "terminality")
        known = cut_lineage(rows.select(*_KEY, "ends", "met", F.when(F.col("terminality") < TERMINAL, 0).otherwise(F.col("last")).alias("kept"), F.col("last")), "truncate-kept")


# near-copies ----------------------------------------------------------------------------

class _Hashes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_WORDS = _Hashes()


def runs_of(words: list[str], size: int) -> np.ndarray:
    """A number for each run of ``size`` words, in order."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    out = h[:n].copy()
    for i in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + n]
    return out ^ (out >> np.uint64(29))


def tail_of(words: list[str]) -> int | None:
    """The last whole words, without the last one, which may be broken."""
    return int(runs_of(words[-TAIL - 1 : -1], TAIL)[0].view(np.int64)) if len(words) > TAIL + 1 else None


class Bands:
    """Keys of the windows of a text, those of its longest window last."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
        self.fold = rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)

    def __call__(self, runs: np.ndarray) -> list[int]:
        sizes = [FIRST]
        while sizes[-1] * STEP <= len(runs):
            sizes.append(sizes[-1] * STEP)
        if len(runs) < FIRST:
            return []
        values = self.a[:, None] * runs[: sizes[-1]] + self.b[:, None]  # a row for each hash, so that the minima run along rows
        mins = np.minimum.accumulate(np.minimum.reduceat(values, [0, *sizes[:-1]], axis=1), axis=1).T
        salt = np.arange(len(sizes) * BANDS, dtype=np.uint64).reshape(-1, BANDS) * np.uint64(0xD6E8FEB86659FD93)
        keys = (mins.reshape(len(sizes), BANDS, ROWS) * self.fold).sum(2, dtype=np.uint64) * np.uint64(31) + salt
        return keys.view(np.int64).ravel().tolist()


_PROFILE = "digest binary, n_runs long, bands array<long>, tail long, place string, core string, signs string, seen long, ends long, last long"


def profile(documents: DataFrame) -> DataFrame:
    """One pass over the texts. Of each: ``doc_id``, ``digest``, ``n_runs``, ``bands``, ``tail``, and its closing word's key (null: no text).

    Between them, with ``seen`` not null, the counts of closing words that ``terminality`` adds up.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in _PROFILE.split(", "))]

    def run(batches):
        import xxhash

        bands, counts, key = Bands(), Positions(), None

        def flush():
            rows = counts.rows()
            columns = list(zip(*rows)) if rows else [()] * 6
            empty = [pa.nulls(len(rows), t) for t in (key, pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
            return pa.RecordBatch.from_arrays([*empty, *(pa.array(c, pa.string()) for c in columns[:3]), *(pa.array(c, pa.int64()) for c in columns[3:])], names)

        for batch in batches:
            key = batch.schema.field("doc_id").type
            digests, sizes, keys, tails, ends = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                shown = body(text)
                runs = runs_of((text or "").split(), SHINGLE)
                digests.append(xxhash.xxh3_128_digest((text or "").encode()))
                sizes.append(len(runs)), keys.append(bands(runs)), tails.append(tail_of(shown.rsplit(None, TAIL + 2)))
                ends.append(counts.add(shown) or (None, None, None))
            columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(tails, pa.int64()), *(pa.array(c, pa.string()) for c in (zip(*ends) if ends else [()] * 3))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *[pa.nulls(len(sizes), pa.int64())] * 3], names)
            if counts.large():
                yield flush()
                counts = Positions()
        if key is not None:
            yield flush()

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_PROFILE}")


class Ending(NamedTuple):
    """What ``ends_early`` asks of the shorter text, the same for many texts of a family."""

    shown: str  # the last characters of its body
    size: int
    broken: bool  # in an open code block or a character
    ended: bool  # behind the signs that end a sentence
    marker: bool  # behind the sign of an item without the item
    word: str  # the last word without the stop
    vague: bool  # a line's end behind it says nothing
    plain: bool  # in a line of running text


_ENDING = "shown string, size long, broken boolean, ended boolean, marker boolean, word string, vague boolean, plain boolean"


def ending(text: str | None) -> Ending:
    a, raw = body(text), _stripped(text or "")
    last = a.rsplit("\n", 1)[-1].strip()
    broken = sum(line.lstrip().startswith("```") for line in a.split("\n")) % 2 == 1 or raw.endswith("�")
    word = last.split()[-1].lstrip("\"“«„‘'([")[:-1] if last else ""
    vague = a != _without_signs(raw) or last[-1:] in ",;:(-–—/&'’"
    plain = not (_ITEM.match(last) or _HEADING.match(last) or "|" in last)
    return Ending(a[-160:], len(a), broken, bool(_END.search(a)), bool(_MARKER.fullmatch(last)), word, vague, plain)


def _goes_on(end: Ending, rest: str, long: str) -> bool:
    """Whether the sentence at ``end``, which ends with a stop, goes on in ``rest``, in the same line."""
    stop, word = end.shown[-1], end.word
    if stop in "。！？":
        return False
    after = rest.lstrip(" \t  \"“«„‘'([¿¡") if rest[0].isspace() else rest
    if not after:
        return False
    first = after[0]
    if first.islower():
        return True
    if not rest[0].isspace() and (first.isdigit() or first in "”’»)]"):
        return True
    if stop != ".":
        return False
    if end.marker:
        return True
    if word.lower() in _SHORT or len(word) == 1 and word.isupper():
        return True
    if word.isdigit():
        return len(word) <= 2 and bool(_MONTH.match(after))
    # a stop behind which the longer text goes on in lower case elsewhere
    return bool(word) and re.search(rf"(?<!\w){re.escape(word)}\.[  ]+[a-zà-ÿ]", long) is not None


def ends_early(end: Ending, long: str) -> str:
    """How a text with this ``end`` ends in ``long``: "cut", "whole", or "apart" where they don't align or that says nothing."""
    for size in (160, 80, 40, 24):
        tail = end.shown[-size:]
        at = long.find(tail) if len(tail) >= 24 else -1
        if at >= 0:
            break
    else:
        return "apart"
    again = long.find(tail, at + 1)
    if again >= 0:
        # the stretch repeats: the place nearest to the same distance from the start
        places = [at]
        while again >= 0:
            places.append(again)
            again = long.find(tail, again + 1)
        at = min(places, key=lambda p: abs(p + len(tail) - end.size))
    rest = long[at + len(tail) :]
    if not rest.strip(_INVISIBLE).strip():
        return "apart"  # two texts may be cut at the same place
    if end.broken:
        return "cut"
    line, _, below = rest.partition("\n")
    shown = _without_signs(_without_first_signs(line)).strip(_INVISIBLE).strip()
    if shown:
        if not end.ended:
            return "cut"
        return "cut" if _goes_on(end, line if line[:1] == shown[:1] else " " + shown, long) else "whole"
    if end.ended:
        return "whole"
    if end.vague:
        return "apart"
    wrapped = below[:1].islower() and end.plain and not _ITEM.match(below)
    return "cut" if wrapped else "whole"


def _held(documents: DataFrame, ids: DataFrame, tails: DataFrame) -> DataFrame:
    """(``longer``, ``tail``): which of ``tails`` stand in the texts of ``ids`` with two more words behind them."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            owner, found = [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                runs = np.unique(runs_of((text or "").split()[:-2], TAIL))
                owner.append(np.full(len(runs), r)), found.append(runs)
            take = pa.array(np.concatenate(owner).astype(np.int64) if owner else np.empty(0, np.int64))
            flat = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), pa.array(flat.view(np.int64))], ["longer", "tail"])

    texts = documents.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return texts.mapInArrow(run, f"longer {kind}, tail long").join(tails, "tail", "left_semi")


def meetings(documents: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``band``, ``tail``, ``doc_id``) of the texts that have one longer, (``band``, ``tail``, ``longer``) of these.

    ``texts``: profiles, of equal texts one. Only texts of a bucket that is some text's longest window are looked at.
    """
    keyed = texts.select("doc_id", "tail", F.size("bands").alias("n"), F.posexplode("bands").alias("at", "band"))
    keyed = keyed.select("band", "doc_id", "tail", (F.col("at") >= F.col("n") - BANDS).alias("own")).repartition("band")
    several = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).where("n > 1 and own").select("band")
    crowded = cut_lineage(keyed.join(several, "band", "left_semi"), "truncate-crowded")
    asked = crowded.where("own and tail is not null").select("band", "tail", "doc_id")
    held = _held(documents, crowded.select("doc_id").distinct(), asked.select("tail").distinct())
    longer = crowded.select("band", F.col("doc_id").alias("longer")).join(held, "longer")
    longer = longer.join(asked.select("band", "tail").distinct(), ["band", "tail"], "left_semi")
    return asked, cut_lineage(longer.select("band", "tail", "longer"), "truncate-longer")


def endings(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(``doc_id``, ``ending``, the fields of ``Ending``) of the texts of ``ids``; ``ending`` is a number for these."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        types = [pa.int64() if t == "long" else pa.bool_() if t == "boolean" else pa.string() for t in (c.split()[1] for c in _ENDING.split(", "))]
        for batch in batches:
            found = [ending(text) for text in batch.column("text").to_pylist()]
            numbers = np.array([xxhash.xxh64_intdigest(repr(tuple(e)).encode("utf-8", "surrogatepass")) for e in found], np.uint64).view(np.int64)
            fields = zip(*found) if found else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(numbers), *map(pa.array, fields, types)], ["doc_id", "ending", *Ending._fields])

    return documents.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(run, f"doc_id {kind}, ending long, {_ENDING}")


def told(documents: DataFrame, pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """(``longer``, ``ending``, ``alignment``) of the pairs (``longer``, ``ending``), a table, where the longer text tells something."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select(F.col("doc_id").alias("longer"), F.col("text").alias("other")).join(pairs.select("longer").distinct(), "longer", "left_semi")
    rows = pairs.join(ends, "ending").join(texts, "longer")

    def run(batches):
        for batch in batches:
            fields = zip(*(batch.column(c).to_pylist() for c in Ending._fields))
            how = [ends_early(Ending(*end), other) for end, other in zip(fields, batch.column("other").to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column("longer"), batch.column("ending"), pa.array(how, pa.string())], ["longer", "ending", "alignment"])
            yield out.filter(pa.array([h != "apart" for h in how], pa.bool_()))

    return rows.select("longer", "ending", "other", *Ending._fields).mapInArrow(run, f"longer {kind}, ending long, alignment string")


def aligned(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """(``digest``, ``alignment``) of the texts with a verified longer near-copy that tells: "cut" if any goes on.

    Every text can be the shorter one and the longer one. A group may hold any share of the texts. First its longer
    ones are asked once for each different ending. Then those that tell a cut are verified, and only for texts without
    a verified one those that tell a whole end, so the first verified one is final and the rounds don't change what is
    found: each takes so many longer ones of a group as its limit says, already before they are shuffled.
    """
    own = F.struct("doc_id", "tail", "bands")
    texts = profiles.where((F.size("bands") > 0) & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min(own).alias("own")).select("own.*")
    asked, longer = meetings(documents, texts)
    asked = asked.join(longer.select("band", "tail").distinct(), ["band", "tail"], "left_semi")
    ends = cut_lineage(endings(documents, asked.select("doc_id").distinct()), "truncate-endings")
    asked = cut_lineage(asked.join(ends.select("doc_id", "ending"), "doc_id"), "truncate-asked")
    met = cut_lineage(longer.join(asked.select("band", "tail", "ending").distinct(), ["band", "tail"]), "truncate-met")
    how = told(documents, met.select("longer", "ending").distinct(), ends.drop("doc_id").dropDuplicates(["ending"]))
    group = ["band", "tail", "ending"]
    order = Window.partitionBy("alignment", *group).orderBy(F.xxhash64("longer"), "longer")
    placed = cut_lineage(met.join(how, ["longer", "ending"]).withColumn("at", F.row_number().over(order)), "truncate-placed")
    most = dict(placed.groupBy("alignment").agg(F.max("at")).collect())
    found = asked.select("doc_id", F.lit("").alias("alignment")).where("false")
    for alignment in ("cut", "whole"):
        done, width = 0, ROUND
        while done < most.get(alignment, 0):
            now = placed.where((F.col("alignment") == alignment) & (F.col("at") <= done + width) & (F.col("at") > done))
            # as a table, so that the few texts of a round are looked up without a shuffle of all
            pairs = cut_lineage(asked.join(now, group).where("doc_id <> longer").select("doc_id", "longer").distinct(), "truncate-pairs")
            done, width = done + width, width * 4
            if pairs.isEmpty():
                continue
            ids = cut_lineage(verified(documents, pairs), "truncate-verified")
            asked = asked.join(ids, "doc_id", "left_anti")
            found = found.unionByName(ids.withColumn("alignment", F.lit(alignment)))
    # a text is found in one round at most
    return profiles.select("doc_id", "digest").join(found, "doc_id").select("digest", "alignment")


def verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``doc_id`` of pairs (``doc_id``, ``longer``) where the longer text holds the other one's runs, each once."""
    # of both sides only the texts that are in a pair
    wanted = pairs.select("doc_id").union(pairs.select("longer")).distinct()
    texts = documents.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    rows = pairs.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("longer"), F.col("text").alias("other")), "longer").select("doc_id", "text", "other")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = []
            for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "other"))):
                # the last word may be broken
                x, y = np.unique(runs_of(body(a).split()[:-1], SHINGLE)), np.unique(runs_of(b.split(), SHINGLE))
                if len(x) and len(np.intersect1d(x, y, assume_unique=True)) >= SIMILARITY * len(x):
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type)], ["doc_id"])

    return rows.mapInArrow(run, f"doc_id {kind}").distinct()


# both -----------------------------------------------------------------------------------


def truncated(documents: DataFrame, terminal: float = TERMINAL) -> DataFrame:
    """(``doc_id``, ``evidence``): the documents whose text was cut.

    ``documents``: ``doc_id`` (unique), ``text``; more columns are ignored. ``evidence`` is ``alignment`` or
    ``closing word``. Null, empty and blank texts are none, nor are texts of signs only. Rows without ``doc_id`` can't be
    named, but their texts count. Texts of fewer than eight words, and those cut within the very last word of their
    copy, are left to the closing words.
    """
    profiles = cut_lineage(profile(documents), "truncate-profiles")
    own = profiles.where("seen is null and doc_id is not null")
    alignments = aligned(documents, own)
    # many texts end alike: the few words there are stand once for each salt
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")
    words = terminality(profiles.where("seen is not null").select(*_KEY, "seen", "ends", "last")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = own.where("place is not null").select("doc_id", "digest", *_KEY, salt.alias("salt")).join(alignments, "digest", "left").join(words, [*_KEY, "salt"], "left")
    seldom = F.coalesce("terminality", F.lit(0.0)) < terminal
    evidence = F.when(F.col("alignment") == "cut", "alignment").when(F.col("alignment").isNull() & seldom, "closing word")
    return rows.select("doc_id", evidence.alias("evidence")).where("evidence is not null")


def source_rates(documents: DataFrame) -> DataFrame:
    """(``source``, ``n_documents``, ``n_truncated``, ``share``) of every source, the null one too."""
    cut = truncated(documents).select("doc_id", F.lit(1).alias("cut"))
    rows = documents.select("doc_id", "source").join(cut, "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count("cut").alias("n_truncated")).withColumn("share", F.col("n_truncated") / F.col("n_documents"))
