"""Problem 3: personal information in free text, replaced by typed placeholders.

Generators with a high recall propose spans, which may overlap: e-mail addresses with written
or spelled-out signs, runs of digits with separators (as telephone and as identity number),
streets with a house number before a postcode and town, and words that look like names in
all the forms of a person's name. Features of format and context of each span go to boosted
trees, one model a kind; a calibrated probability is held against the kind's threshold.
Of overlapping spans that pass, an address goes before an e-mail address, this before a number,
a longer name before a shorter one. Identity numbers must, besides, stand the test of their
check digits or letter.

The models are trained on made sentences (``pii_train``), in which the spans are known; the names in
them come from the table of name parts, put together anew, so that a name that is in no
table is known by its form and its company.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("address", "email", "identity", "phone", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

_L = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ̀-ͯ"
_U = "A-ZÀ-ÖØ-Þ"
_BLANK = r"[ \u00a0\u2007\u2009\u202f]"

#: Words of several languages by which the context is told (fixed values).
TITLES = set("m mme mlle me monsieur madame mademoiselle maitre dr dre docteur prof professeur herr herrn frau fr mr mrs ms miss sir sig sigra signor signora sig.ra sig.na dott dottssa dott.ssa dottor dottoressa avv ing sr sra srta don dona d d.a doctor doctora lic abg".split())
COMPANY_AFTER = set("ag sa gmbh ltd sarl sarl srl spa sl slu inc kg llc plc co cie sas snc ug se sagl limited".split())
COMPANY_BEFORE = set("firma societe firm company ditta empresa unternehmen entreprise azienda compania haus maison".split())
STREET_BEFORE = set("rue avenue av boulevard bd chemin place impasse quai route allee cours passage ruelle sentier faubourg via viale vicolo piazza corso largo strada piazzale calle avenida paseo plaza camino ronda carrer travesia carretera".split())
STREET_AFTER = set("street road lane close avenue drive way court square gardens terrace place row crescent hill grove walk mews strasse straße gasse weg platz allee".split())
PHONE_WORDS = set("tel telefon telephone telefono tfno phone call fax mobile mobil handy natel portable cellulare movil numero rappelee rappele contacter appeler joindre joignable au unter ruckruf erreichbar line hotline pikettdienst picchetto guardia urgence heure llame richiamata richiamato chiamare reach reachable localizable raggiungibile back on al".split())
ID_WORDS = set("ahv avs nir dni nif steuer id identification identifiee identifie assure assuree assurance versicherte versichertennummer number nummer numero n identity insured person persona assicurata asegurada patiente patient ausweis tessera carte card securite sociale svnr".split())
ORDER_WORDS = set("commande auftrag order ordine pedido reference riferimento referencia article articles artikel items item articoli articulos lot batch charge lotto lote version softwarestand firmware versione chf eur usd facture rechnung invoice fattura factura iban konto compte ref dossier".split())

#: Frequent words of three languages (fixed values).
_FRENCH = set("le la les du des est et au une pour à dans sur avec par de en".split())
_SPANISH = set("el los las del y una con por en según que se su al de la".split())
_GERMAN = set("der die das und des mit von im den dem ist an auf bei nach wird".split())

_EMAIL = re.compile(
    r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}"
    r"(?:@|\s{0,2}[(\[{<]\s?(?:at|a|arobase|chiocciola|arroba|@|ät)\s?[)\]}>]\s{0,2}|\s(?:at|arobase|chiocciola|arroba)\s)"
    r"[A-Za-z0-9][A-Za-z0-9\-]*"
    r"(?:(?:\.|\s?[(\[{]\s?(?:dot|point|punkt|punto|\.)\s?[)\]}]\s?|\s(?:dot|point|punkt|punto)\s)[A-Za-z0-9][A-Za-z0-9\-]*)+",
    re.IGNORECASE,
)
_AT = re.compile(r"@|[(\[{<]\s?(?:at|a|arobase|chiocciola|arroba|ät)\s?[)\]}>]|\s(?:at|arobase|chiocciola|arroba)\s.{1,60}?(?:\.|dot|point|punkt|punto)", re.IGNORECASE)
_SEP = r"[ \u00a0\u2000-\u200a\u202f.\-/\u2010\u2011\u2013]"
_DIGITS = re.compile(rf"(?<![\w.,/@])(?:\+\s?)?\(?\d(?:(?:{_SEP}|[()]){{0,3}}\d){{6,19}}(?![\d@])")
_LETTERED = re.compile(r"(?<![\w.,/@-])\d{1,2}[. \u00a0\u2009\u202f]?\d{3}[. \u00a0\u2009\u202f]?\d{3}[- \u00a0\u2010\u2011\u202f]?[A-Za-z](?![\w@])")
_CORSICA = re.compile(r"(?<![\w.,/@])[12][. \u00a0\u2009\u202f]?\d\d[. \u00a0\u2009\u202f]?\d\d[. \u00a0\u2009\u202f]?2[AB][. \u00a0\u2009\u202f]?\d{3}[. \u00a0\u2009\u202f]?\d{3}[. \u00a0\u2009\u202f]?\d\d(?!\w)")

_NUMBER = r"\d{1,4}(?:\s?(?:bis|ter|[a-zA-Z]))?"
_FR = r"(?i:rue|avenue|av\.|boulevard|bd|chemin|ch\.|place|impasse|quai|route|allée|allee|cours|passage|ruelle|sentier|square|faubourg|montée|esplanade)"
_SOUTH = r"(?i:via|viale|vicolo|piazza|corso|largo|strada|piazzale|contrada|calle|c/|avenida|avda\.?|paseo|plaza|camino|ronda|travesía|carretera|pasaje)"
_DE = rf"[{_U}][{_L}'’\-]*(?i:strasse|straße|str\.|gasse|weg|platz|allee|ring|ufer|damm|steig|graben|rain|halde|matte|hof|feld)"
_EN = r"(?i:Street|Road|Lane|Close|Avenue|Drive|Way|Court|Square|Gardens|Terrace|Place|Row|Crescent|Hill|Grove|Walk|Mews|St\.?|Rd\.?)"
_NAMED = rf"[^\d,;|\n<>@:()]{{2,45}}?"
_UNIT = r"(?i:,\s*(?:\d{1,2}\s?[ºª°o]\.?\s*[A-Za-z]?|(?:piso|int\.?|interno|scala|app\.?|appt\.?|apt\.?|appartement|appartamento|Wohnung|Whg\.?|Flat|Stock|étage|etage|planta|puerta|esc\.?)\s*\w{1,4}|\d{1,2}(?:e|er|ème|\.)\s*(?:étage|etage|Stock|OG)))?"
_FLAT = r"(?i:(?:Flat|Apartment|Apt\.?|Unit|Suite|Appartement|Appt\.?|App\.?)\s+\w{1,4},?\s+)?"
_STREETS = re.compile(
    rf"{_FLAT}(?:{_NUMBER},?\s+{_FR}\s+{_NAMED}"
    rf"|{_NUMBER},?\s+(?:[{_U}][{_L}'’\-]*\s+){{1,3}}{_EN}"
    rf"|(?<![\w'’]){_SOUTH}\s+{_NAMED},?\s+(?:n\.?[º°]?\s*)?{_NUMBER}"
    rf"|(?<![\w'’]){_FR}\s+{_NAMED},?\s+{_NUMBER}"
    rf"|(?<!\w)(?:(?:(?:Alte|Neue|Obere|Untere|Kleine|Gross|Groß|Lange|Hintere|Vordere)[{_L}]*\s+)?{_DE}|(?:Am|An der|An den|Im|In der|Auf der|Zum|Zur|Beim)\s+[{_U}][{_L}\-]+)\s+{_NUMBER})"
    rf"{_UNIT}\s*(?:[,;/–\-·|]|\n)?\s*$"
)
_POSTAL = re.compile(rf"(?<![\w.,'’/\-])(?:[A-Z]{{1,3}}[-–]\s?)?\d{{4,5}}\s+([{_U}][{_L}'’]+(?:-[{_L}'’]+)*)")
_TOWN_FIRST = re.compile(rf"([{_U}][{_L}'’\-]+),?\s+(?:(?:[A-Z]{{1,3}}[-–]\s?)?\d{{4,5}}|[A-Z]{{1,2}}\d[A-Z\d]?\s?\d[A-Z]{{2}})(?![\w.]\w|\w)")

_TOKEN = re.compile(rf"[{_U}][{_L}]*(?:[’'\-][{_L}]+)*")
_GAP = re.compile(rf"{_BLANK}{{1,3}}|,{_BLANK}{{1,2}}")
_WORD_BEFORE = re.compile(rf"(?<![\w.ªº'’&@])([{_L}.ªº'’&@]+)[^\w]{{0,6}}$")
_NONE = (0.0,) * 6
_DIGIT = re.compile(r"\d")
_INITIAL = re.compile(rf"(?<![{_L}\d.])[{_U}]̀?\.(?:[-]?{_BLANK}?[{_U}]\.)?{_BLANK}?$")


def folded(word: str) -> str:
    word = unicodedata.normalize("NFKD", word.lower()) if not word.isascii() else word.lower()
    return "".join(c for c in word if not unicodedata.combining(c)) if not word.isascii() else word


def ahv(d: str) -> bool:
    """Swiss number: 13 digits from 756 with the check digit of an EAN."""
    return len(d) == 13 and d.startswith("756") and (10 - sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(d[:12])) % 10) % 10 == int(d[12])


def nir(d: str) -> bool:
    """French number: 13 places and the key 97 - n mod 97; 2A and 2B of Corsica as 19 and 18."""
    d = d.upper().replace("2A", "19", 1) if "A" in d.upper() else d.upper().replace("2B", "18", 1)
    return len(d) == 15 and d.isdigit() and d[0] in "123478" and 97 - int(d[:13]) % 97 == int(d[13:])


def dni(d: str) -> bool:
    """Spanish number: 8 digits and the letter of the rest by 23."""
    return len(d) == 9 and d[:8].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(d[:8]) % 23] == d[8].upper()


def tax(d: str) -> bool:
    """German tax number of a person: 11 digits, not from 0, check digit of ISO 7064 (11, 10)."""
    if len(d) != 11 or not d.isdigit() or d[0] == "0":
        return False
    product = 10
    for c in d[:10]:
        s = (int(c) + product) % 10 or 10
        product = 2 * s % 11
    return (11 - product) % 10 == int(d[10])


def valid_identity(surface: str) -> bool:
    d = re.sub(r"[^0-9A-Za-z]", "", surface)
    if d.isdigit():
        return ahv(d) or nir(d) or tax(d)
    return dni(d) or nir(d)


@dataclass
class Names:
    """What is known of names: the parts, and the beginnings and ends these share."""

    given: frozenset = frozenset()
    family: frozenset = frozenset()
    given_ends: frozenset = frozenset()
    family_ends: frozenset = frozenset()
    any_given_ends: frozenset = frozenset()
    any_family_ends: frozenset = frozenset()
    given_heads: frozenset = frozenset()
    family_heads: frozenset = frozenset()
    cache: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def of(parts: list[tuple[str, str]]) -> Names:
        from collections import Counter

        given = [folded(p) for p, k in parts if p and k == "given"]
        family = [folded(p) for p, k in parts if p and k == "family"]

        def often(values, least: int) -> frozenset:
            return frozenset(v for v, n in Counter(values).items() if n >= least)

        gh, fh = often((w[:n] for w in given for n in (2, 3, 4) if len(w) > n), 2), often((w[:n] for w in family for n in (3, 4) if len(w) > n), 2)
        return Names(frozenset(given), frozenset(family), often((w[-3:] for w in given), 2), often((w[-n:] for w in family for n in (3, 4)), 2), often((w[-n:] for w in given for n in (3, 4)), 1), often((w[-n:] for w in family for n in (3, 4)), 1), gh, fh)

    def look(self, word: str) -> tuple[float, ...]:
        """(given, family, like a given, like a family, ends like a given, like a family); hyphenated ones by their parts."""
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            parts = [folded(p) for p in re.split(r"[-’']", word) if p]
            g = all(p in self.given for p in parts)
            f = all(p in self.family for p in parts)
            gl = all(len(p) > 4 and (p[:4] in self.given_heads or p[:3] in self.given_heads or p[:2] in self.given_heads) and p[-3:] in self.given_ends for p in parts)
            fl = all((p[:4] in self.family_heads or p[:3] in self.family_heads) and (p[-4:] in self.family_ends or p[-3:] in self.family_ends) for p in parts)
            ends = [any(parts[-1][-n:] in known for n in (3, 4)) if parts else False for known in (self.any_given_ends, self.any_family_ends)]
            found = self.cache[word] = (float(g), float(f), float(gl), float(fl), float(ends[0]), float(ends[1]))
        return found


def _before(text: str, at: int) -> str:
    m = _WORD_BEFORE.search(text, max(0, at - 28), at)
    return folded(m.group(1)).strip(".") if m else ""


def _titled(text: str, at: int) -> bool:
    word = text[max(0, at - 14) : at].split()[-1:]
    return bool(word) and (word[0].strip(".,").lower() in TITLES or "ª" in word[0] or "î" in word[0])


def _cues(text: str, a: int, b: int) -> list[float]:
    """Which words stand near: the 40 characters before, 25 behind."""
    near = [folded(w) for w in re.findall(rf"[{_L}]+", text[max(0, a - 45) : a])][-5:]
    behind = [folded(w) for w in re.findall(rf"[{_L}]+", text[b : b + 25])][:3]
    return [float(any(w in PHONE_WORDS for w in near)), float(any(w in ID_WORDS for w in near)), float(any(w in ORDER_WORDS for w in near)), float(any(w in ORDER_WORDS for w in near[-2:])), float(any(w in PHONE_WORDS for w in behind))]


def number_features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    digits = re.sub(r"\D", "", s)
    groups = [len(g) for g in re.findall(r"\d+", s)]
    seps = set(re.sub(r"[\d+()A-Za-z]", "", s))
    plain = s.replace("(0)", "")
    alnum = re.sub(r"[^0-9A-Za-z]", "", s)
    return [
        len(digits), float(s.startswith("+")), float(digits.startswith("00")), float(digits.startswith("0")), float("(" in s), len(groups), groups[0], groups[-1], max(groups), min(groups[1:] or [0]), float("." in seps), float("-" in seps), float("/" in seps), float(any(c.isspace() for c in seps)), len(seps),
        float(ahv(digits)), float(nir(digits)), float(tax(digits)), float(dni(alnum)), float(digits.startswith("756")), float(s[-1].isalpha()), float("(0)" in s), len(re.sub(r"\D", "", plain)), float(bool(re.match(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}$", s))), float(a == 0 or text[a - 1] == "\n"), float(text[b : b + 1] in ("\n", "")), float("|" in text[max(0, a - 2) : a] or "|" in text[b : b + 2] or ";" in text[max(0, a - 2) : a]),
        float(digits[:2] in ("33", "44", "49", "41", "39", "34", "43", "32")), float(digits[:4] in ("0033", "0044", "0049", "0041", "0039", "0034", "0043")), *_cues(text, a, b),
    ]


def email_features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    at = re.search(r"@|\W(?:at|a|arobase|chiocciola|arroba|ät)\W", s, re.IGNORECASE)
    local, domain = (s[: at.start()], s[at.end() :]) if at else (s, "")
    top = re.split(r"[^A-Za-z0-9]+", domain)[-1]
    return [len(s), len(local), len(domain), float("@" in s), float(bool(re.search(r"[(\[{<]", s))), float(bool(re.search(r"\s(?:at|arobase|chiocciola|arroba)\s", s, re.IGNORECASE))), float(top.isalpha()), len(top), float(local.isdigit()), float(any(c.isalpha() for c in local)), float(bool(re.search(r"\b(?:dot|point|punkt|punto)\b", domain, re.IGNORECASE))), float(top[:1].isupper() and not top.isupper()), float(text[max(0, a - 1) : a] == "<"), float(" " in domain)]


def address_features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    before = _before(text, a)
    first = folded(re.match(r"[^\s,]*", s).group())
    return [float(first in STREET_BEFORE), float(first in ("flat", "apt", "apartment", "unit", "suite")), float(bool(re.match(rf"{_DE}\s", s))), float(text[max(0, a - 2) : a].strip(", ").isdigit()), float(before.isalpha() and a > 0 and text[a - 1] == " " and before in ("flat", "apt", "apartment")), len(s), float(s[0].isdigit()), float(s[:1].isupper()), s.count(","), float("\n" in s), float(bool(re.search(r"\d{5}", s))), len(re.findall(r"\d+", s)), len(s.split()), float(before in STREET_BEFORE), float(a > 0 and text[a - 1].isalnum()), float(text[a : a + 1].islower()), float(bool(re.search(r"[.!?]\s", s)))]


def name_features(text: str, words: list[tuple[int, int]], a: int, b: int, names: Names) -> list[float]:
    """``words``: the capitalised words of the span, initials not among them."""
    s = text[a:b]
    looks = [names.look(text[x:y]) for x, y in words]
    first, last = looks[0], looks[-1]
    before, behind = _before(text, a), re.match(rf"[^{_L}]{{0,3}}([{_L}ªº&.]+)", text[b : b + 24])
    behind = folded(behind.group(1)).strip(".") if behind else ""
    close = text[b : b + 1] in tuple(" \u00a0\u2009\u202f")
    after_and = bool(re.match(r"\s&\s", text[b : b + 3]))
    upper = [text[x:y].isupper() and y - x > 1 for x, y in words]
    near = _TOKEN.match(text, b + 1) if close else None
    near_look = names.look(near.group()) if near else _NONE
    comma = _TOKEN.match(text, b + 2) if text[b : b + 2] == ", " else None
    comma_look = names.look(comma.group()) if comma else _NONE
    prior = re.search(rf"([{_U}][{_L}]*(?:[’'\-][{_L}]+)*)(,?){_BLANK}$", text[max(0, a - 30) : a])
    prior_look = names.look(prior.group(1)) if prior else _NONE
    initial = float(words[0][0] > a)
    around = {w.lower() for w in re.findall(r"[^\W\d_]+", text[max(0, a - 90) : b + 70])}
    french, spanish, german = len(around & _FRENCH), len(around & _SPANISH), len(around & _GERMAN)
    return [
        float(initial and s[0] == "M"), float(initial and s[0] == "D"), float(french > max(spanish, german)), float(spanish > max(french, german)),
        len(words), initial, float("," in s), *first, *last, float(before in TITLES), float(before in COMPANY_BEFORE), float(before in STREET_BEFORE), float(close and behind in COMPANY_AFTER or after_and), float(close and behind in STREET_AFTER),
        float(all(upper)), float(any(upper)), float("-" in s), max(near_look[:4]), float(max(near_look[1], near_look[3])), max(comma_look[:4]), max(prior_look[:4]), float(bool(prior) and prior.group(2) == ","), float(bool(_INITIAL.search(text, max(0, a - 8), a))), float(a > 0 and text[a - 1] in "@._+/-’'"), float(text[b : b + 1] in "@_+/"), float(bool(re.match(r"\s*[,]?\s*\d", text[b : b + 5]))), float(a == 0 or text[max(0, a - 2) : a].strip(" \xa0")[-1:] in (".", "\n", "!", "?", ":")),
    ]


def _overlaps(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(a < y and x < b for x, y in spans)


def propose(text: str, names: Names) -> dict[str, list[tuple[int, int, list[float]]]]:
    """Candidate spans with their features, by kind."""
    out: dict[str, list[tuple[int, int, list[float]]]] = {k: [] for k in KINDS}
    mails: list[tuple[int, int]] = []
    if _AT.search(text):
        for m in _EMAIL.finditer(text):
            a, b = m.span()
            mails.append((a, b))
            out["email"].append((a, b, email_features(text, a, b)))
    if _DIGIT.search(text):
        seen = set()
        for rx in (_DIGITS, _LETTERED, _CORSICA):
            for m in rx.finditer(text):
                a, b = m.span()
                s = m.group()
                if s[0] == "(" and ")" not in s:
                    a += 1
                if (a, b) in seen or _overlaps(mails, a, b):
                    continue
                seen.add((a, b))
                f = number_features(text, a, b)
                if rx is _DIGITS:
                    out["phone"].append((a, b, f))
                out["identity"].append((a, b, f))
        places = [(m.start(), m.end(1)) for m in _POSTAL.finditer(text)] + [(m.start(1), m.end()) for m in _TOWN_FIRST.finditer(text)]
        for at, end in places:
            for start in _street_before(text, max(0, at - 110), at):
                out["address"].append((start, end, address_features(text, start, end)))
    words, tokens = [], [m.span() for m in _TOKEN.finditer(text)]
    looks = [names.look(text[a:b]) if b - a > 2 else _NONE for a, b in tokens]
    near = set()
    for i, ((a, b), look) in enumerate(zip(tokens, looks)):
        if look[0] or look[1] or look[2] or look[3]:
            near.add(i)
            # a part of a name that no table has stands beside one that is known
            if i and _GAP.fullmatch(text, tokens[i - 1][1], a):
                near.add(i - 1)
            if i + 1 < len(tokens) and _GAP.fullmatch(text, b, tokens[i + 1][0]):
                near.add(i + 1)
        elif b - a > 2 and _titled(text, a):
            near.add(i)
            if i + 1 < len(tokens) and _GAP.fullmatch(text, b, tokens[i + 1][0]):
                near.add(i + 1)
    for i in sorted(near):
        a, b = tokens[i]
        if b - a > 2 and not _overlaps(mails, a, b):
            words.append((a, b))
    made = set()
    for i, (a, b) in enumerate(words):
        spans = [(a, b, [(a, b)])]
        m = _INITIAL.search(text, max(0, a - 8), a)
        if m:
            spans.append((m.start(), b, [(a, b)]))
        if i + 1 < len(words) and _GAP.fullmatch(text, b, words[i + 1][0]):
            c, d = words[i + 1]
            spans.append((a, d, [(a, b), (c, d)]))
            if i + 2 < len(words) and "," not in text[b : words[i + 2][0]] and _GAP.fullmatch(text, d, words[i + 2][0]):
                e, f = words[i + 2]
                spans.append((a, f, [(a, b), (c, d), (e, f)]))
        for x, y, parts in spans:
            if (x, y) not in made:
                made.add((x, y))
                out["name"].append((x, y, name_features(text, parts, x, y, names)))
    return out


_START = re.compile(rf"(?<![{_L}\d])(?=(?i:Flat|Apartment|Apt\.?|Unit|Suite|Appartement|Appt\.?|App\.?)\s+\w|\d{{1,4}}(?:\s?(?:bis|ter|[a-zA-Z]))?,?\s+[{_L}]|{_FR}\s|{_SOUTH}\s|[{_U}])")


def _street_before(text: str, lo: int, at: int):
    """Starts of a street with a number that ends just before ``at``."""
    window = text[lo:at]
    if not _DIGIT.search(window):
        return
    for m in _START.finditer(window):
        if _STREETS.match(window, m.start()):
            yield lo + m.start()


class Finder:
    """The trained models, thresholds and names; small, the same size whatever the data."""

    def __init__(self, models: dict, thresholds: dict, names: Names):
        self.models, self.thresholds, self.names = models, thresholds, names

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the mentions of each text, in order, without overlaps."""
        rows: dict[str, list] = {k: [] for k in KINDS}
        spans: dict[str, list] = {k: [] for k in KINDS}
        for i, text in enumerate(texts):
            if text:
                for kind, found in propose(text, self.names).items():
                    for a, b, f in found:
                        spans[kind].append((i, a, b))
                        rows[kind].append(f)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for kind in KINDS:
            if not rows[kind]:
                continue
            p = self.models[kind].probability(np.asarray(rows[kind]))
            kept = [(i, a, b, q) for (i, a, b), q in zip(spans[kind], p) if q >= self.thresholds[kind]]
            if kind == "identity":
                kept = [x for x in kept if valid_identity(texts[x[0]][x[1] : x[2]])]
            # the surer spans first, of about equally sure ones the longer
            for i, a, b, _ in sorted(kept, key=lambda x: (x[0], -round(x[3], 1), x[1] - x[2], x[1])):
                if not any(a < y and x < b for x, y, _ in out[i]):
                    out[i].append((a, b, kind))
        for found in out:
            found.sort()
        return out


def finder(spark: SparkSession, name_parts: DataFrame) -> Finder:
    """Trained here; the table of name parts is a list of words of a language, not of the data.

    All distinct parts come to the driver, for the lookup; the models learn from at most ``pii_train.MOST_PARTS`` of them.
    """
    from tamarack.llm import pii_train

    return pii_train.trained(pii_train.read_parts(name_parts))


def mentions(texts: DataFrame, found: Finder) -> DataFrame:
    """(``id``, ``kind``, ``surface``, ``start``, ``stop``) of every mention, repeated ones each time.

    ``texts``: ``id``, ``text``; more columns are ignored. Null and empty texts have none.
    """
    shared = texts.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        finder_ = shared.value
        for batch in batches:
            texts_ = batch.column("text").to_pylist()
            rows = [(i, a, b, k) for i, spans in enumerate(finder_.find(texts_)) for a, b, k in spans]
            ids = batch.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[3] for r in rows], pa.string()), pa.array([texts_[r[0]][r[1] : r[2]] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["id", "kind", "surface", "start", "stop"])

    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, kind string, surface string, start int, stop int")


def redacted(texts: DataFrame, found: Finder) -> DataFrame:
    """(``id``, ``text``, ``n_mentions``): the texts with placeholders, all else unchanged; null texts stay null."""
    shared = texts.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        finder_ = shared.value
        for batch in batches:
            texts_, out, counts = batch.column("text").to_pylist(), [], []
            for text, spans in zip(texts_, finder_.find(texts_)):
                at, made = 0, []
                for a, b, kind in spans:
                    made += [text[at:a], PLACEHOLDER[kind]]
                    at = b
                out.append(None if text is None else "".join(made) + text[at:])
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string()), pa.array(counts, pa.int32())], ["id", "text", "n_mentions"])

    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, text string, n_mentions int")
