import random
from collections import Counter

import numpy as np
import pytest

from tamarack.llm import pii, pii_train
from tamarack.llm.boost import Boosted, threshold

GIVEN = ["Aurvmund", "Aurvric", "Cathdawen", "Cathric", "Dagnric", "Dagnmiina", "Jolane", "Jolwen", "Lummund", "Lumelle", "Quenric", "Quenthea", "Wilthea", "Wilrowen", "Orlwen", "Orllis"]
FAMILY = ["Brandard", "Brandmann", "Dervberg", "Dervanquist", "Fenzacci", "Fenzstein", "Grivez", "Grivstein", "Halvmann", "Halvelberg", "Krelarre", "Krelumberg", "Lomaux", "Lomberg", "Torvmann", "Torvulet"]
PARTS = tuple((p, "given") for p in GIVEN) + tuple((p, "family") for p in FAMILY)


@pytest.fixture(scope="module")
def finder():
    return pii_train.trained(PARTS)


CASES = [
    ("Le piano est pour Mme Jolane Lomaux, à joindre au 06 39 98 57 45 ou à j.lomaux [at] piano [dot] test.", [("name", "Jolane Lomaux"), ("phone", "06 39 98 57 45"), ("email", "j.lomaux [at] piano [dot] test")]),
    ("Das Foto kam von BRANDMANN Quenric <QUENRIC@MAIL.TULPE.TEST> per Post.", [("name", "BRANDMANN Quenric"), ("email", "QUENRIC@MAIL.TULPE.TEST")]),
    ("A cat lives at Flat 8, 53a Elm Street, 36973 Ashford, behind the shop.", [("address", "Flat 8, 53a Elm Street, 36973 Ashford")]),
    ("Bring the cake to 41a Park Lane, Woodfield WA6 8QZ. Thanks.", [("address", "41a Park Lane, Woodfield WA6 8QZ")]),
    ("La bicicleta está en calle San Juan 125, 1º C, 6900 Monteverde, al lado del pozo.", [("address", "calle San Juan 125, 1º C, 6900 Monteverde")]),
    ("Das Klavier steht am Rosenweg 166, CH-1212 Neustadt im Keller.", [("address", "Rosenweg 166, CH-1212 Neustadt")]),
    ("La boulangerie Grivstein SA vend 10236912H tartes dans la rue Lomberg chaque été.", []),
    ("Trois tartes à 4 @ 7.25 et le bon 01 99 76 sont perdus.", []),
    ("On en parle sur @equipe-legal depuis 3.18@7.", []),
    ("Il gelato di Fenzacci, Orlwen è buono.", [("name", "Fenzacci, Orlwen")]),
    ("A photo by A. Torvulet hangs there.", [("name", "A. Torvulet")]),
    ("Nothing personal here.", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_mentions(finder, text, want):
    assert [(k, text[a:b]) for a, b, k in finder.find([text])[0]] == want


def test_identity_numbers_by_their_checks(finder):
    maker, hits = pii_train.Maker(list(PARTS), 5), 0
    for _ in range(60):
        good, bad = maker.identity(), maker.badid()
        assert pii.valid_identity(good) and not pii.valid_identity(bad)
        text = f"Auf dem Zettel steht {good}, auf dem Paket {bad}."
        hits += [(k, text[a:b]) for a, b, k in finder.find([text])[0] if k == "identity"] == [("identity", good)]
    assert hits >= 58
    assert pii.ahv("7569217076985") and not pii.ahv("7569217076984")
    assert pii.dni("12345678Z") and pii.tax("86095742719") and pii.nir("255081416802538")


def test_held_out_accuracy(finder):
    maker = pii_train.Maker(list(PARTS), 77)
    made = [maker.text() for _ in range(600)]
    tp, fp, fn = Counter(), Counter(), Counter()
    for (_, want), got in zip(made, finder.find([t for t, _ in made])):
        got = {(k, a, b) for a, b, k in got}
        for k in pii.KINDS:
            w, g = {s for s in want if s[0] == k}, {s for s in got if s[0] == k}
            tp[k] += len(w & g)
            fp[k] += len(g - w)
            fn[k] += len(w - g)
    for k in pii.KINDS:
        assert tp[k] / (tp[k] + fn[k]) > 0.93 and tp[k] / (tp[k] + fp[k]) > 0.95, k


def test_rows_and_placeholders(spark, finder):
    rows = [("a", CASES[0][0], 1), ("b", None, 2), ("c", "", 3), ("d", "x " * 50_000, 4), ("a", CASES[0][0], 5), ("e", "Nothing.", 6)]
    df = spark.createDataFrame(rows, "id string, text string, kind int")
    got = [(r.id, r.kind, r.surface) for r in pii.mentions(df, finder).collect()]
    assert Counter(got) == Counter([("a", *c) for c in CASES[0][1]] * 2)
    out = {r.id: r.text for r in pii.redacted(df, finder).collect()}
    assert out["a"] == "Le piano est pour Mme [NAME], à joindre au [PHONE] ou à [EMAIL]."
    assert out["b"] is None and out["c"] == "" and out["d"] == "x " * 50_000 and out["e"] == "Nothing."
    assert pii.mentions(df.where("false"), finder).count() == 0


def test_name_parts_table(spark):
    df = spark.createDataFrame([("Jolane", "given"), ("Jolane", "given"), (None, "given"), ("x", None), ("Lomaux", "family")], "name_part string, kind string")
    assert pii_train.read_parts(df) == (("Lomaux", "family"), ("Jolane", "given"))


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 4))
    y = (x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.05)
    model = Boosted().fit(x[:2000], y[:2000]).calibrate(x[2000:2500], y[2000:2500])
    p = model.probability(x[2500:])
    assert ((p > 0.5) == y[2500:]).mean() > 0.85
    assert abs(p.mean() - y[2500:].mean()) < 0.06
    assert 0.05 <= threshold(p, y[2500:]) <= 0.95 and len(model.probability(np.zeros((0, 4)))) == 0


def test_random_texts_never_fail(finder):
    r = random.Random(3)
    signs = "aB1 .,@()[]+-/\n|<>éÉªº°Lomaux Jolane rue 12 8000 Valdorf Str. Mme"
    texts = ["".join(r.choice(signs) for _ in range(400)) for _ in range(60)]
    for text, spans in zip(texts, finder.find(texts)):
        assert all(0 <= a < b <= len(text) for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_the_lookup_has_the_whole_list(spark, monkeypatch):
    monkeypatch.setattr(pii_train, "MOST_PARTS", 8)
    parts = pii_train.read_parts(spark.createDataFrame(list(PARTS), "name_part string, kind string"))
    names = pii_train.trained(parts, texts=60).names
    assert names.given == {pii.folded(p) for p in GIVEN} and names.family == {pii.folded(p) for p in FAMILY}
    assert len(pii_train.sample(list(parts))) == 8 and {k for _, k in pii_train.sample(list(parts))} == {"given", "family"}
