"""Problem 7: the language of texts and of their segments, with a confidence.

Each language has a probability for every piece of a fixed public vocabulary. The score of a
word is the sum over all its segmentations into pieces of the products of their
probabilities, by the forward algorithm (in logarithms); no segmentation goes over a
word's end, so a text's score is the sum over its words, and a worker keeps the scores of
the words it has met. The probabilities are learned here by expectation maximisation
(forward and backward) on a bounded sample of labelled records: about ``SAMPLE`` records,
chosen by a hash of the id. Labels may be wrong: after a first round records that the
model gives to another language are left out and the model is learned again.

A text is cut into segments at line ends and sentence ends. A segment's confidence is the
softmax of the scores. Neighbouring segments of one language that are short, or whose lead over the text's main language
is small, are given to the main language.
"""

from __future__ import annotations

import functools
import math
import os
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import plain_text

LANGUAGES = ("fr", "de", "en", "it", "es")
FOLDER, VOCABULARY = "/opt/tokenizers", "piece_bpe_32k"
SAMPLE, ROUNDS = 5000, 4
FLOOR = 1e-7
MOST = 4.0  # for the choice of a language a word counts at most so much against any, so that a foreign name decides nothing; not for the confidence
LEAD, LEAST_WORDS = 6.0, 6
RECORD_WORDS = 8

#: Names of the languages in labels, plain and in lower case (fixed values).
NAMES = {
    "fr": "fr fra fre french francais franzosisch francese frances",
    "de": "de deu ger german deutsch allemand tedesco aleman",
    "en": "en eng english anglais englisch inglese ingles",
    "it": "it ita italian italiano italien italienisch",
    "es": "es spa spanish espanol castellano espagnol spanisch spagnolo",
}
#: Labels that say that the language isn't known (fixed values).
UNKNOWN = "unknown und undetermined undefined none null na n/a nan ? - xx mis mul zxx inconnu unbekannt desconocido sconosciuto other auto".split()

_LABELS = {name: code for code, names in NAMES.items() for name in names.split()}
_WORD = re.compile(r"[^\W\d_]+")
_SKIP = re.compile(r"\S*(?:@|://|www\.|\d)\S*")
_BREAK = re.compile(r"(?<=[.!?…])(?<!\s\d\.)(?<!\s\d\d\.)[\"»”’)\]]*\s+(?=[\"«“„(¿¡]*[^\W\d_a-z])|\s*\n\s*")
_LOWER_BREAK = re.compile(r"(?<=[.!?…])(?<!\s\d\.)(?<!\s\d\d\.)[\"»”’)\]]*\s+(?=[\"«“„(¿¡]*[^\W\d_])|\s*\n\s*")
_SEGMENTS = "segment int, start int, stop int, lang string, confidence double, n_words int"


def named(label: str | None) -> str | None:
    """The language a label names; None if it names none; any other name as it is."""
    if label is None:
        return None
    plain = plain_text(label).strip()
    if not plain or plain in UNKNOWN:
        return None
    head = re.split(r"[-_ (/]", plain)[0]
    return _LABELS.get(plain) or _LABELS.get(head) or plain


@functools.lru_cache(maxsize=2)
def pieces(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> dict[str, int]:
    """The vocabulary's pieces in lower case; a word begins with a mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{vocabulary}.model"))
    out: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if not model.is_control(i) and not model.is_byte(i) and not model.is_unknown(i) and all(c.isalpha() or c == "▁" for c in piece) and "▁" not in piece[1:]:
            out.setdefault(piece, len(out))
    return out


def lattice(word: str, known: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(from, to, piece) of all pieces in the word, at most ``longest`` characters each; -1 for a character that is none."""
    text = "▁" + word
    out = []
    for a in range(len(text)):
        single = False
        for b in range(a + 1, min(len(text), a + longest) + 1):
            p = known.get(text[a:b])
            if p is not None:
                out.append((a, b, p))
                single |= b == a + 1
        if not single:
            out.append((a, a + 1, -1))
    return out


class Model:
    """Piece probabilities, pieces x languages."""

    def __init__(self, known: dict[str, int], probability: np.ndarray):
        self.known, self.probability = known, probability
        self.longest = max(map(len, known), default=1)

    def word(self, word: str) -> list[float]:
        """The log of the forward sum of a word for each language, over all segmentations, whatever its length."""
        n = len(word) + 1
        forward = np.zeros((n + 1, self.probability.shape[1]))
        forward[0] = 1.0
        scale, at = np.zeros(forward.shape[1]), 0
        for a, b, p in lattice(word, self.known, self.longest):
            if a >= at + 24:
                # long words: what lies ahead is made greater again, so that it doesn't vanish
                at, least = a, np.maximum(forward[a], 1e-300)
                forward[a : a + self.longest + 1] /= least
                scale += np.log(least)
            forward[b] += forward[a] * (self.probability[p] if p >= 0 else FLOOR)
        return (np.log(np.maximum(forward[n], 1e-300)) + scale).tolist()


def learn(counts: list[Counter], known: dict[str, int], rounds: int = ROUNDS) -> Model:
    """From the word counts of each language. Words so long that their probability is below the least number teach nothing."""
    n, longest = len(known), max(map(len, known), default=1)
    probability = np.full((n + 1, len(counts)), 0.0)
    for k, words in enumerate(counts):
        lattices = [(lattice(w, known, longest), len(w) + 1, c) for w, c in words.items()]
        p = np.full(n + 1, 1.0 / (n + 1))
        for _ in range(rounds):
            expected = np.zeros(n + 1)
            values = p.tolist()
            for edges, last, c in lattices:
                forward = [0.0] * (last + 1)
                backward = [0.0] * (last + 1)
                forward[0] = backward[last] = 1.0
                for a, b, e in edges:
                    forward[b] += forward[a] * values[e]
                for a, b, e in reversed(edges):
                    backward[a] += backward[b] * values[e]
                total = forward[last]
                if total <= 0:
                    continue
                for a, b, e in edges:
                    expected[e] += c * forward[a] * values[e] * backward[b] / total
            p = (expected + 0.01) / (expected.sum() + 0.01 * (n + 1))
        probability[:, k] = np.maximum(p, FLOOR)
    return Model(known, probability[:n])


def words_of(text: str) -> list[str]:
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    return _WORD.findall(_SKIP.sub(" ", text.lower()))


def segments(text: str) -> list[tuple[int, int]]:
    """Spans of lines and sentences that hold something; a text without capitals is cut at every sentence end."""
    out, at = [], 0
    for m in (_BREAK if text != text.lower() else _LOWER_BREAK).finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


class Scorer:
    """Scores of segments; remembers words."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.rows: list[list[float]] = []
    def index(self, word: str) -> int:
        i = self.at.get(word)
        if i is None:
            if len(self.at) > 400_000:
                self.at.clear()
                self.rows.clear()
            i = self.at[word] = len(self.rows)
            found = self.model.word(word)
            most = max(found)
            self.rows.append([*(max(x, most - MOST) for x in found), *found])
        return i

    def scores(self, parts: list[list[str]]) -> np.ndarray:
        """A row for each list of words: the scores that choose, those with MOST, and the whole ones."""
        out = np.zeros((len(parts), 2 * len(LANGUAGES)))
        for lo in range(0, len(parts), 4000):
            block = parts[lo : lo + 4000]
            if len(self.at) > 300_000:
                self.at.clear()
                self.rows.clear()
            index = [self.index(w) for words in block for w in words]
            if index:
                table = np.asarray(self.rows)
                owner = np.repeat(np.arange(len(block)), [len(w) for w in block])
                for k in range(out.shape[1]):
                    out[lo : lo + len(block), k] = np.bincount(owner, table[index, k], len(block))
        return out


def assign(scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and confidence of each segment of one text.

    Neighbouring segments of one language stand together against the text's main language; the confidence is the whole
    likelihood's.
    """
    if not sizes.sum():
        return np.full(len(sizes), -1), np.zeros(len(sizes))
    scores, whole = scores[:, : len(LANGUAGES)], scores[:, len(LANGUAGES) :]
    best = scores.argmax(1)
    weight = np.bincount(best, sizes, len(LANGUAGES))
    main = int(weight.argmax())
    lead = scores[np.arange(len(best)), best] - scores[:, main]
    run = np.cumsum(np.r_[False, best[1:] != best[:-1]])
    best = np.where((np.bincount(run, sizes)[run] < LEAST_WORDS) | (np.bincount(run, lead)[run] < LEAD), main, best)
    odds = np.exp(whole - whole.max(1, keepdims=True))
    sure = odds[np.arange(len(best)), best] / odds.sum(1)
    return np.where(sizes > 0, best, main), np.where(sizes > 0, sure, 0.0)


def train(records: DataFrame, rows: int | None = None, sample: int = SAMPLE, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Model:
    """The model from labelled records (``id``, ``text``, ``lang``), whatever their order.

    About ``sample`` of them come to the driver, never more than twice as many; ``rows`` is the
    number of records where it is known.
    """
    share = min(1.0, sample / max(rows if rows is not None else records.count(), 1))
    some = records.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003).limit(2 * sample)
    rows = [(named(r["lang"]), words_of(r["text"])) for r in some.select("lang", "text").collect() if r["text"]]
    rows = [(LANGUAGES.index(lang), words) for lang, words in rows if lang in LANGUAGES and len(words) >= 5]
    known = pieces(folder, vocabulary)

    def fit(chosen, rounds: int) -> Model:
        counts = [Counter() for _ in LANGUAGES]
        for k, words in chosen:
            counts[k].update(words)
        return learn(counts, known, rounds)

    if not rows:
        return fit([], 1)
    first = Scorer(fit(rows, 2))
    sure = first.scores([w for _, w in rows])[:, : len(LANGUAGES)].argmax(1)
    return fit([r for r, s in zip(rows, sure) if r[0] == s], ROUNDS)


def identify(texts: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """(``id``, ``carry``, ``segment``, ``start``, ``stop``, ``lang``, ``confidence``, ``n_words``) of each text's segments.

    ``texts``: ``id``, ``text``. ``start`` and ``stop`` count characters. Null, empty and blank
    texts have no segment; a segment without words has a null language and confidence 0 if the
    whole text has none.
    """
    shared = texts.sparkSession.sparkContext.broadcast((model.known, model.probability))  # the vocabulary's size
    kept = ["id", *carry]

    def run(batches):
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            spans, parts, owner = [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                for a, b in segments(text or ""):
                    spans.append((a, b)), parts.append(words_of(text[a:b])), owner.append(r)
            scores = scorer.scores(parts)
            sizes = np.array([len(p) for p in parts], np.int64)
            owner = np.array(owner, np.int64)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
            langs, sure, place = np.full(len(owner), -1), np.zeros(len(owner)), np.zeros(len(owner), np.int32)
            for a, b in zip(starts, np.r_[starts[1:], len(owner)]):
                langs[a:b], sure[a:b] = assign(scores[a:b], sizes[a:b])
                place[a:b] = np.arange(b - a)
            take = pa.array(owner)
            columns = [batch.column(c).take(take) for c in kept]
            names = [LANGUAGES[k] if k >= 0 else None for k in langs]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place), pa.array([s[0] for s in spans], pa.int32()), pa.array([s[1] for s in spans], pa.int32()), pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array(sizes.astype(np.int32))], [*kept, "segment", "start", "stop", "lang", "confidence", "n_words"])

    head = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in kept)
    return texts.select(*kept, "text").mapInArrow(run, head + _SEGMENTS)


def relabel(texts: DataFrame, model: Model) -> DataFrame:
    """(``id``, ``lang``, ``n_words``, ``confidence``): the languages of records whose label needs correction.

    ``texts``: ``id``, ``text``, ``label``. A record of at least RECORD_WORDS words comes out if its
    label is missing, names another language than the text's, or the text holds segments of more
    than one language of at least RECORD_WORDS words together; a row for each such
    language. Labels in another spelling of the right language are right.
    """
    shared = texts.sparkSession.sparkContext.broadcast((model.known, model.probability))

    def run(batches):
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            parts, raw, owner = [], [], []
            labels = batch.column("label").to_pylist()
            for r, text in enumerate(batch.column("text").to_pylist()):
                for a, b in segments(text or ""):
                    parts.append(words_of(text[a:b])), raw.append(len(text[a:b].split())), owner.append(r)
            scores = scorer.scores(parts)
            sizes, raw, owner = np.array([len(p) for p in parts], np.int64), np.array(raw, np.int64), np.array(owner, np.int64)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
            rows, out, words, sure = [], [], [], []
            for a, b in zip(starts, np.r_[starts[1:], len(owner)]):
                if raw[a:b].sum() < RECORD_WORDS or not sizes[a:b].sum():
                    continue
                lang, confidence = assign(scores[a:b], sizes[a:b])
                total = np.bincount(lang, raw[a:b], len(LANGUAGES))
                held = [k for k in range(len(LANGUAGES)) if total[k] >= RECORD_WORDS]
                if len(held) > 1 or held and named(labels[owner[a]]) != LANGUAGES[held[0]]:
                    for k in held:
                        mine = lang == k
                        rows.append(owner[a]), out.append(LANGUAGES[k]), words.append(int(total[k]))
                        sure.append(float((confidence[mine] * raw[a:b][mine]).sum() / total[k]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(out, pa.string()), pa.array(words, pa.int64()), pa.array(sure, pa.float64())], ["id", "lang", "n_words", "confidence"])

    return texts.select("id", "text", "label").mapInArrow(run, "id string, lang string, n_words long, confidence double")
