"""Training of the mention models on made sentences.

A sentence is made from a frame of one of five languages; the fillers are drawn at random in many
forms. Fillers for persons, addresses and so on are the mentions; others look like them
but aren't (companies with a family's name, streets alone, order numbers, numbers with
a wrong check digit, versions, handles). The generators of ``pii`` run over the made texts; a
candidate is right if it is exactly a mention of its kind.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import pii
from tamarack.llm.boost import Boosted, threshold

#: Bounds of what is learned from: name parts, made texts (two thirds for the trees, the rest to calibrate).
MOST_PARTS, TEXTS, SEED = 20_000, 4200, 3

FRAMES = {
    "fr": [
        "Merci de joindre {name} au {phone} avant midi.", "Le courrier de {titled} est resté chez {company}.", "Adresse de livraison : {address}.", "{titled} habite {address} depuis mars.", "Écrivez à {email} ou appelez le {phone}.", "L'assuré {name}, numéro {identity}, a répondu.", "La commande {order} du {date} porte la référence {order}.", "La maison {company} a livré {order} pièces dans la {street}.",
        "Le dossier {badid} concerne {company}.", "{name}\n{phone}\n{email}", "{name} | {identity} | {phone} | {email}", "Le montant de {amount} sera versé le {date}.", "D'après {titled}, tout est prêt.", "Contact : {titled}, {address}, {phone}", "Le comité se réunit à {town} sans {given}.", "Le logiciel {version} est livré par {company}.", "Réponse de {name} <{email}> reçue.", "Le canal {handle} suit {company}.", "Envoyer à l'adresse suivante : {address}", "Les peintres passent lundi chez {company}.", "La patiente portant le {identity} rappelle le {phone}.", "Sur la feuille il y a {identity}, puis {badid}.", "{identity}",
    ],
    "de": [
        "Bitte rufen Sie {titled} unter {phone} an.", "Die Post geht an {address}.", "Gemäss {name} ist die Akte vollständig.", "Die Nummer {identity} gehört zu {titled}.", "Schreiben Sie an {email}.", "Der Auftrag {order} vom {date} kommt von der {company}.", "Die Lieferung {badid} steht in der {street}.", "{name}; {identity}; {address}", "{titled}\n{address}\n{phone}", "Der Betrag von {amount} ist am {date} fällig.", "Die Firma {company} prüft den Artikel {badid}.", "Die Maler kommen am Montag zur {company}.", "Wohnsitz {address} seit Jahren.", "Weiter an {name} <{email}> gesandt.", "Im Kanal {handle} steht die Version {version}.", "Nach Auskunft von {titled} ist {given} nicht in {town}.", "Rückruf auf {phone} erbeten, Ausweis {identity}.", "Im Auftrag von {name} wird bezahlt.", "Unten steht {identity}, daneben {badid}.", "{badid}, {identity}",
    ],
    "en": [
        "Please ring {titled} on {phone} or write to {email}.", "Parcels go to {address} only.", "According to {name}, the file is complete.", "Number {identity} belongs to {titled}.", "Order {order} of {date} came from {company}.", "The firm {company} keeps item {badid} in {street}.", "{name}, {address}, {phone}", "{titled} | {phone} | {email}", "The sum of {amount} is due on {date}.", "Painters come to {company} on Monday.", "The tenant of {address} has left.", "Sent on by {name} <{email}> today.", "Channel {handle} mentions version {version}.", "Nobody saw {given} in {town}.", "Card {identity} was issued to {name}.", "On behalf of {name} the register is closed.", "A talk with {titled} took place.", "The sheet shows {identity} and {badid}.", "{identity} {date}",
    ],
    "it": [
        "Chiamare {titled} al {phone} prima di sera.", "La posta va a {address}.", "Secondo {name} il fascicolo è completo.", "Il numero {identity} è di {titled}.", "Scrivere a {email}.", "L'ordine {order} del {date} viene da {company}.", "La ditta {company} espone l'articolo {badid} nella {street}.", "{name}\n{address}\n{email}", "{titled}; {identity}; {phone}", "L'importo di {amount} scade il {date}.", "Gli imbianchini vanno lunedì dalla {company}.", "Residente in {address} da anni.", "Inoltrato da {name} <{email}> ieri.", "Nel canale {handle} si cita la versione {version}.", "Il colloquio con {titled} è finito.", "Nessuno ha visto {given} a {town}.", "Sul foglio c'è {identity} e poi {badid}.", "{identity}.",
    ],
    "es": [
        "Llame a {titled} al {phone} hoy.", "El correo va a {address}.", "Según {name} el expediente está completo.", "El número {identity} es de {titled}.", "Escriba a {email}.", "El pedido {order} del {date} viene de {company}.", "La empresa {company} expone el artículo {badid} en la {street}.", "{name}\n{phone}\n{address}", "{titled} | {identity} | {phone} | {email}", "El importe de {amount} vence el {date}.", "Los pintores van el lunes a {company}.", "Con domicilio en {address} desde hace años.", "Reenviado por {name} <{email}> ayer.", "En el canal {handle} figura la versión {version}.", "Tras la charla con {titled} se cerró.", "Nadie vio a {given} en {town}.", "En la hoja está {identity} y luego {badid}.", "{order}: {identity}",
    ],
}
TITLES = {"fr": ["M.", "Mme", "Me", "Dr", "Mme", "Monsieur"], "de": ["Herr", "Frau", "Herrn", "Dr.", "Prof."], "en": ["Mr", "Ms", "Mrs", "Dr.", "Mr."], "it": ["sig.", "la sig.ra", "dott.", "il sig.", "dott.ssa", "avv."], "es": ["Sr.", "Sra.", "D.", "D.ª", "Dr."]}
STREETS = {"fr": ["rue", "avenue", "chemin", "place", "impasse", "quai", "boulevard", "allée"], "it": ["via", "viale", "vicolo", "piazza", "corso"], "es": ["calle", "avenida", "paseo", "plaza", "camino"]}
STREET_NAMES = {"fr": ["Victor-Hugo", "de la Paix", "des Écoles", "Pasteur", "du Château", "des Roses", "de l'Abbaye"], "it": ["Roma", "della Pace", "Dante", "San Marco", "dei Fiori"], "es": ["Real", "de la Paz", "San Juan", "de los Reyes", "de Alcalá"]}
GERMAN_HEADS, GERMAN_TAILS = ["Wald", "Rosen", "Schul", "Haupt", "Brunnen", "Wiesen", "Kirch", "Sonnen"], ["strasse", "straße", "gasse", "weg", "platz", "allee"]
ENGLISH_HEADS, ENGLISH_TAILS = ["High", "Park", "Victoria", "Old King", "Green", "Elm", "Market"], ["Street", "Road", "Lane", "Close", "Avenue"]
TOWN_HEADS, TOWN_TAILS = ["Neu", "Ober", "Wald", "Grün", "Roche", "Font", "Castel", "Monte", "Ash", "Wood"], ["heim", "stadt", "feld", "court", "bourg", "field", "ford", "verde", "rosa", "bach"]
FORMS = ["AG", "SA", "GmbH", "Ltd", "& Cie", "SARL", "SpA"]


class Maker:
    """Draws fillers; everything follows from the seed."""

    def __init__(self, parts: list[tuple[str, str]], seed: int):
        self.rng = random.Random(seed)
        self.givens = sorted({p for p, k in parts if k == "given"}) or ["Anna", "Marc"]
        self.families = sorted({p for p, k in parts if k == "family"}) or ["Keller", "Moret"]

    def one(self, values):
        return self.rng.choice(values)

    def digits(self, n: int) -> str:
        return "".join(self.one("0123456789") for _ in range(n))

    def mingled(self, values: list[str]) -> str:
        """A listed part, or a new one from the beginning of one and the end of another."""
        if self.rng.random() < 0.6:
            return self.one(values)
        a, b = self.one(values), self.one(values)
        if self.rng.random() < 0.2:
            a = self.one("BCDFGKLMNPRSTVW") + self.one("aeiou") + self.one("rlnstm") + "uai"
        return a[: max(3, min(5, len(a) - 3))] + b[-self.one([3, 4, 5]) :]

    def family(self) -> str:
        f = self.mingled(self.families)
        return f"{f}-{self.mingled(self.families)}" if self.rng.random() < 0.08 else f

    def name(self) -> str:
        g, f = self.mingled(self.givens), self.family()
        form = self.rng.random()
        if form < 0.5:
            s = f"{g} {f}"
        elif form < 0.62:
            s = f"{f}, {g}"
        elif form < 0.76:
            s = f"{g[0]}. {f}"
        elif form < 0.86:
            s = f"{f.upper()} {g}"
        else:
            s = f"{f} {g}"
        return s.upper() if self.rng.random() < 0.08 else s

    def town(self) -> str:
        return self.one(TOWN_HEADS) + self.one(["", "o", "a", "en"]) + self.one(TOWN_TAILS)

    def invented(self) -> str:
        """A company's name: two or three syllables."""
        syllables = (self.one("bcdfgklmnprstvz") + self.one("aeiou") + self.one(["", "", "l", "n", "r", "x"]) for _ in range(self.one([2, 2, 3])))
        return "".join(syllables).capitalize()

    def street(self, lang: str) -> str:
        if lang == "de":
            return self.one(GERMAN_HEADS) + self.one(GERMAN_TAILS)
        if lang == "en":
            return f"{self.one([*ENGLISH_HEADS, self.one(self.families)])} {self.one(ENGLISH_TAILS)}"
        return f"{self.one(STREETS[lang])} {self.one([*STREET_NAMES[lang], self.one(self.families)])}"

    def address(self, lang: str) -> str:
        number = str(self.rng.randint(1, 190)) + self.one(["", "", "", "a", "b", "A", " bis"][: 6 if lang != "fr" else 7])
        street = self.street(lang)
        if lang in ("fr", "en"):
            s = f"{number}{self.one([' ', ', ']) if lang == 'fr' else ' '}{street}"
            if lang == "en" and self.rng.random() < 0.3:
                s = f"Flat {self.rng.randint(1, 12)}, {s}"
        else:
            s = f"{street}{self.one([' ', ', ']) if lang != 'de' else ' '}{number}"
            if lang == "es" and self.rng.random() < 0.3:
                s += f", {self.rng.randint(1, 8)}º {self.one('ABCD')}"
        sep = self.one([", ", ", ", " - ", " / ", "\n"])
        code = self.one(["", "", "CH-"]) + str(self.rng.randint(1000, 9999) if self.rng.random() < 0.5 else self.rng.randint(10000, 98999))
        if lang == "en" and self.rng.random() < 0.5:
            letters = "ABCDEFGHJKLNPRSTUW"
            return f"{s.replace('Street', 'St.')}, {self.town()} {self.one(letters)}{self.one(letters)}{self.rng.randint(1, 19)} {self.rng.randint(1, 9)}{self.one(letters)}{self.one(letters)}"
        return f"{s}{sep}{code} {self.town()}" if self.rng.random() < 0.95 else f"{s}{sep}{self.town()} {code}"

    def email(self) -> str:
        local = self.one([f"{self.one(self.givens)}.{self.one(self.families)}", f"{self.one(self.givens)[0]}.{self.one(self.families)}", self.one(self.families) + self.digits(2), f"{self.one(self.givens)}_{self.one(self.families)}", self.one(self.families) + "+news"])
        local = pii.folded(local)
        domain = pii.folded(self.invented()) + self.one([".test", ".example", ".invalid", ".ch", ".com"])
        domain = self.one(["", "", "mail."]) + domain
        at, dot = self.one([("@", "."), ("@", "."), ("@", "."), ("(at)", "."), (" [at] ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) ")])
        s = local + at + domain.replace(".", dot)
        return s.upper() if at == "@" and self.rng.random() < 0.1 else s

    def phone(self) -> str:
        d = self.digits
        return self.one([
            f"+33 {self.one(['1', '6', '(0)1'])} {d(2)} {d(2)} {d(2)} {d(2)}", f"0033 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{self.one('12367')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{self.one('167')}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{self.one('167')}-{d(2)}-{d(2)}-{d(2)}-{d(2)}", f"0{self.one('167')}{d(8)}", f"+336{d(2)}{d(2)} {d(6)}"[: self.one([13, 13, 12])],
            f"+44 {self.one(['', '(0)'])}20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"(020) {d(4)} {d(4)}", f"020{d(8)}", f"+49 {self.one(['', '(0)'])}30 {d(5)}{self.one(['-', ' ', ''])}{d(3)}", f"030 {d(5)} {d(3)}", f"030/{d(8)}", f"+41 {d(2)} {d(3)} {d(2)} {d(2)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}", f"+39 0{d(1)} {d(4)} {d(4)}", f"+34 {d(3)} {d(3)} {d(3)}", f"0041 {d(2)} {d(3)} {d(2)} {d(2)}",
        ])

    def raw_identity(self) -> tuple[str, str]:
        kind = self.one(["ahv", "nir", "dni", "tax"])
        if kind == "ahv":
            s = "756" + self.digits(9)
            return kind, s + next(c for c in "0123456789" if pii.ahv(s + c))
        if kind == "nir":
            s = self.one("12") + self.digits(2) + f"{self.rng.randint(1, 12):02d}" + f"{self.rng.randint(1, 95):02d}" + self.digits(6)
            return kind, s + f"{97 - int(s) % 97:02d}"
        if kind == "dni":
            s = self.digits(8)
            return kind, s + "TRWAGMYFPDXBNJZSQVHLCKE"[int(s) % 23]
        s = self.one("123456789") + self.digits(9)
        return kind, s + next(c for c in "0123456789" if pii.tax(s + c)) if any(pii.tax(s + c) for c in "0123456789") else self.raw_identity()[1]

    def grouped(self, kind: str, s: str) -> str:
        if kind == "ahv":
            sep = self.one([".", ".", " ", ""])
            return sep.join([s[:3], s[3:7], s[7:11], s[11:]])
        if kind == "nir":
            sep = self.one([" ", " ", ""])
            return sep.join([s[0], s[1:3], s[3:5], s[5:7], s[7:10], s[10:13], s[13:]])
        if kind == "dni":
            return self.one([s, s, s.lower(), f"{s[:8]}-{s[8]}", f"{s[:2]}.{s[2:5]}.{s[5:8]}-{s[8]}"])
        sep = self.one([" ", " ", ""])
        return sep.join([s[:2], s[2:5], s[5:8], s[8:]])

    def identity(self) -> str:
        while True:
            kind, s = self.raw_identity()
            if pii.valid_identity(s):
                return self.grouped(kind, s)

    def badid(self) -> str:
        kind, s = self.raw_identity()
        wrong = (s[:-1] + self.one([c for c in "TRWAGMYFPD" if c != s[-1]])) if kind == "dni" else s[:-1] + str((int(s[-1]) + self.rng.randint(1, 9)) % 10)
        return self.grouped(kind, wrong) if not pii.valid_identity(wrong) else self.badid()

    def order(self) -> str:
        d = self.digits
        return self.one([f"2024-{d(5)}", f"{self.one('ABCR')}{self.one('EFKN')}/{d(3)}/{d(2)}", f"{d(2)} {d(2)} {d(2)}", f"{d(1)}.{d(2)}.{d(2)}", f"{d(3)}-{d(2)}", d(7), d(10), d(13), f"{d(4)} {d(4)}", f"{d(3)} {d(3)} {d(3)}"])

    def filler(self, slot: str, lang: str) -> tuple[str, str | None, int]:
        """(string, kind or None, characters before the mention)."""
        if slot in ("name",):
            return self.name(), "name", 0
        if slot == "titled":
            title = self.one(TITLES[lang]) + " "
            return title + (s := self.family() if self.rng.random() < 0.45 else self.name()), "name", len(title)
        if slot in ("email", "phone", "identity"):
            return getattr(self, slot)(), slot, 0
        if slot == "address":
            return self.address(lang), "address", 0
        if slot == "street":
            return self.street(lang), None, 0
        if slot == "company":
            if self.rng.random() < 0.4:
                return f"{self.mingled(self.families)} {self.one(FORMS)}", None, 0
            return self.invented() + (f" {self.one(FORMS)}" if self.rng.random() < 0.8 else ""), None, 0
        if slot == "given":
            return self.mingled(self.givens), None, 0
        if slot == "town":
            return self.town(), None, 0
        if slot == "handle":
            return "@" + self.one(["team", "gruppe", "equipe", "equipo"]) + "-" + self.one(["it", "hr", "legal"]), None, 0
        if slot == "version":
            return f"{self.digits(1)}.{self.digits(2)}@{self.digits(1)}", None, 0
        if slot == "amount":
            return self.one([f"CHF {self.digits(2)}'{self.digits(3)}.-", f"{self.digits(5)} EUR", f"{self.digits(2)} @ {self.digits(1)}.{self.digits(2)}"]), None, 0
        if slot == "date":
            return self.one(["12.03.2021", "7 juin 2020", "2021-05-14", "14/02/2019", f"{self.digits(2)}.{self.digits(2)}.20{self.digits(2)}"]), None, 0
        return (self.order() if slot == "order" else self.badid()), None, 0

    def text(self) -> tuple[str, set[tuple[str, int, int]]]:
        lang = self.one(list(FRAMES))
        out, spans = "", set()
        for frame in self.rng.sample(FRAMES[lang], 2):
            rest = frame
            while "{" in rest:
                plain, _, rest = rest.partition("{")
                slot, _, rest = rest.partition("}")
                s, kind, skip = self.filler(slot, lang)
                out += plain
                if kind:
                    spans.add((kind, len(out) + skip, len(out) + len(s)))
                out += s
            out += rest + self.one([" ", " ", "\n", "\n\n"])
        if self.rng.random() < 0.1:
            out = out.replace(" ", "\u00a0")
        return out, spans


def read_parts(name_parts: DataFrame) -> tuple[tuple[str, str], ...]:
    """The distinct name parts in a fixed order, all of them: the lookup needs the whole list."""
    rows = name_parts.where(F.col("name_part").isNotNull() & F.col("kind").isin("given", "family")).select("name_part", "kind").distinct().orderBy("kind", "name_part").collect()
    return tuple((r["name_part"], r["kind"]) for r in rows)


def sample(parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """At most MOST_PARTS of the parts, evenly from the whole list, so of both kinds."""
    if len(parts) <= MOST_PARTS:
        return parts
    return [parts[i * len(parts) // MOST_PARTS] for i in range(MOST_PARTS)]


@functools.lru_cache(maxsize=4)
def trained(parts: tuple[tuple[str, str], ...], texts: int = TEXTS, seed: int = SEED) -> pii.Finder:
    """The same models for the same name parts, wherever they are trained."""
    maker, names = Maker(sample(list(parts)), seed), pii.Names.of(list(parts))
    rows: dict[str, list[list]] = {k: [[], [], []] for k in pii.KINDS}
    for i in range(texts):
        text, spans = maker.text()
        for kind, found in pii.propose(text, names).items():
            for a, b, f in found:
                rows[kind][0].append(f)
                rows[kind][1].append((kind, a, b) in spans)
                rows[kind][2].append(i)
    models, cuts = {}, {}
    for kind, (x, y, group) in rows.items():
        x, y, held = np.asarray(x, np.float64), np.asarray(y, bool), np.asarray(group) % 3 == 0
        if not len(x) or y.all() or not y.any():
            x, y, held = np.vstack([x, np.zeros((2, x.shape[1]))]) if len(x) else np.zeros((2, 1)), np.r_[y, False, False], np.r_[held, False, True]
        models[kind] = Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])
        cuts[kind] = threshold(models[kind].probability(x[held]), y[held])
    return pii.Finder(models, cuts, names)
