import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.llm import distinct, encode, language, mix, neardup, truncate

rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(2000)]


def sentence(r, n=60):
    return [r.choice(VOCABULARY) for _ in range(n)]


# near-duplicates ------------------------------------------------------------------------


def corpus():
    r, rows = random.Random(3), []
    for g in range(60):
        base = sentence(r)
        rows.append((f"g{g:02d}a", " ".join(base)))
        if g % 2 == 0:
            edited = list(base)
            for _ in range(3):
                edited[r.randrange(60)] = r.choice(VOCABULARY)
            rows.append((f"g{g:02d}b", " ".join(edited)))
        if g % 5 == 0:
            rows += [(f"g{g:02d}c{i}", " ".join(base).upper() + " !") for i in range(3)]
    return rows


def jaccard_pairs(rows, limit=0.5):
    sets = {}
    for i, t in rows:
        w = t.lower().replace("!", "").split()
        if len(t.split()) >= 20:
            sets[i] = set(zip(w, w[1:], w[2:]))
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b])}


def test_pairs_of_brute_force(spark):
    rows = corpus() + [("short", "only a few words"), ("none", None), ("empty", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, text string, sig int")
    got = {tuple(r) for r in neardup.pairs(df).collect()}
    assert got == jaccard_pairs(corpus())
    assert neardup.pairs(df.where("false")).count() == 0


def test_groups_are_the_components(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id string, text string")
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in jaccard_pairs(rows):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    sizes = Counter(root(i) for i in parent)
    want = {(i, root(i)) for i in parent if sizes[root(i)] > 1}
    assert {(r.id, r.group) for r in neardup.groups(df).collect()} == want


def test_many_copies_are_all_paired(spark):
    base = sentence(random.Random(1))
    other = [*base[:57], "zzz", "yyy", "xxx"]
    rows = [(f"c{i:02d}", " ".join(base)) for i in range(70)] + [("d", " ".join(other))]
    got = {tuple(r) for r in neardup.pairs(spark.createDataFrame(rows, "id string, text string")).collect()}
    ids = [r[0] for r in rows]
    assert got == {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]}


def test_runs_go_on_until_the_recall(spark, monkeypatch):
    """Pairs near the limit are met in few runs: one run isn't enough, and the estimate says so."""
    r, rows = random.Random(8), []
    for g in range(150):
        base = sentence(r, 60)
        rows += [(f"a{g}", " ".join(base)), (f"b{g}", " ".join(base[:42] + sentence(r, 16)))]
    df = spark.createDataFrame(rows, "id string, text string")
    want = jaccard_pairs(rows)
    assert len(want) > 100
    monkeypatch.setattr(neardup, "RUNS", 2)
    monkeypatch.setattr(neardup, "MORE", 2)
    report = {}
    got = {tuple(r) for r in neardup.pairs(df, recall=0.99, report=report).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and report["runs"] > 2 and report["recall"] >= 0.99
    assert neardup.estimated_recall(100, 0, 0, 4) == 1 and neardup.estimated_recall(100, 30, 10, 4) < 0.8 and neardup.estimated_recall(0, 0, 0, 1) == 1


def test_a_stock_paragraph_makes_no_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SAMPLED", (1000, 1000))
    r = random.Random(4)
    stock = sentence(r, 30)
    rows = [(f"r{i}", " ".join((stock if i % 10 == 0 else sentence(r, 30)) + sentence(r, 40))) for i in range(3000)]
    rows += [("x", rows[0][1] + " one more")]
    sets = neardup.cut_lineage(neardup._sets(spark.createDataFrame(rows, "id string, text string")))
    n, tokens = sets.count(), sets.select(F.sum(F.size("s"))).first()[0]
    plan = neardup._Plan(neardup._frequencies(sets, tokens), n)
    runs = range(10)
    before = neardup._buckets(sets, plan, runs).groupBy("path").count().agg(F.max("count")).first()[0]
    neardup._find_crowded(sets, plan, runs)
    after = neardup._buckets(sets, plan, runs).groupBy("path").count().agg(F.max("count")).first()[0]
    assert before > 150 and after < before / 2
    assert {tuple(x) for x in neardup.pairs(spark.createDataFrame(rows, "id string, text string")).collect()} == {("r0", "x")}


def test_the_sketch_never_counts_too_little(spark):
    sets = spark.createDataFrame([(i, [1, 2, 3] if i % 3 else [1, 500_000 + i]) for i in range(300)], "sig long, s array<int>")
    sketch = neardup._frequencies(sets, 700)
    got = sketch(neardup.np.array([1, 2, 500_003, 77], neardup.np.int32)).tolist()
    assert 300 <= got[0] <= 330 and 200 <= got[1] <= 220 and got[2] == 1 and got[3] == 0
    wanted = sets.where("sig % 7 = 0").select("sig")
    kept = {x.sig for x in neardup._marked(sets, wanted).collect()}
    assert kept >= {i for i in range(0, 300, 7)} and len(kept) < 100


def test_chain_of_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# terms ----------------------------------------------------------------------------------


def test_z_scores_of_the_formula(spark):
    texts = {"a": "Zèbre zebre zebre the cat", "b": "the cat sat the cat", "c": "the dog", "d": None, "e": "x"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "id string, text string, tf int")
    got = {(r.id, r.term): (r.tf, r.df, r.z) for r in distinct.distinctive(df, prior=10.0).collect()}
    counts = {"a": Counter(zebre=3, the=1, cat=1), "b": Counter(the=2, cat=2, sat=1), "c": Counter(the=1, dog=1)}
    cf = sum(counts.values(), Counter())
    total = sum(cf.values())
    want = {}
    for i, c in counts.items():
        n = sum(c.values())
        for t, tf in c.items():
            a = cf[t] * 10.0 / total
            y, z = tf + a, cf[t] - tf + a
            odds = math.log(y / (n + 10 - y)) - math.log(z / (total - n + 10 - z))
            want[i, t] = (tf, sum(t in d for d in counts.values()), odds / math.sqrt(1 / y + 1 / z))
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert got["a", "zebre"][2] > got["a", "the"][2]
    assert {(r.id, r.term) for r in distinct.distinctive(df, least=3, df_most=1).collect()} == {("a", "zebre")}
    assert distinct.distinctive(df.where("false")).count() == 0


# encoding -------------------------------------------------------------------------------

TRICKY = ["", " ", "a", "  two  blanks ", "x" * 5000, "né — ça va ? 🙂👩‍👩‍👧", "漢字かな交じり文" * 200, "<|endoftext|> is text", "tab\t\tnew\n\n line \r\n end", "don't we'll I'm " * 100, "1234567890 " * 300, "a  b   c    d " * 200, "　wide blank " * 90]


@pytest.mark.parametrize("bits", [3, 6, 9])
def test_ids_agree_with_the_whole_text(bits):
    enc, memory = encode.encoder(), encode.Memory(4000)
    r = random.Random(bits)
    texts = TRICKY + [" ".join(sentence(r, 400)) for _ in range(5)] + ["".join(r.choice("ab \n'é🙂.1") for _ in range(3000)) for _ in range(20)]
    for t in [t for t in texts for _ in range(2)]:
        assert encode.encode(t, enc, memory, bits) == enc.encode_ordinary(t)
    assert memory.reused > 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300), st.integers(1, 4))
def test_any_text(t, bits):
    enc = encode.encoder()
    assert encode.encode(t, enc, encode.Memory(10_000), bits) == enc.encode_ordinary(t)
    assert enc.decode(encode.encode(t, enc, encode.Memory(10_000), bits)) == t


def test_chunks_move_with_their_content():
    r = random.Random(2)
    text = " ".join(sentence(r, 2000))
    shared = set(encode.chunks(text)) & set(encode.chunks("something else before it " + text))
    assert len(shared) > 0.8 * len(set(encode.chunks(text))) and "".join(encode.chunks(text)) == text


def test_token_rows(spark):
    df = spark.createDataFrame([(1, None, "s", 3), (2, "", None, 3), (3, "hello world", "s", 3)], "doc_id long, text string, source string, ids int")
    assert {r.doc_id: list(r.ids) for r in encode.token_ids(df).collect()} == {1: [], 2: [], 3: encode.encoder().encode_ordinary("hello world")}
    got = encode.token_ids(df, count=True, carry=["source"])
    assert {(r.doc_id, r.source, r.n_tokens) for r in got.collect()} == {(1, "s", 0), (2, None, 0), (3, "s", 2)}
    assert encode.token_ids(df.where("false")).count() == 0


# mixing ---------------------------------------------------------------------------------


def mixing(spark):
    rows = [(i, "big", 10, 0) for i in range(4000)] + [(10_000 + i, "small", 10, 0) for i in range(300)] + [(20_000, None, 50, 0), (20_001, "unlisted", 70, 0), (20_002, "big", 0, 0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, rate int")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.1, 2), ("zero", 0.0, 2), (None, 0.5, 1), ("null", None, None)], "source string, target_share double, max_repeats int")
    return sized, targets


def test_shares_are_met_within_the_caps(spark):
    sized, targets = mixing(spark)
    rates = {r.source: r.rate for r in mix.source_rates(sized.groupBy("source").agg({"n_tokens": "sum"}).toDF("source", "tokens"), targets).collect()}
    # small has 3000 tokens, at most three times: 9000 of 30000
    assert rates["small"] == pytest.approx(3.0) and rates["big"] == pytest.approx(21000 / 40000)
    assert rates["unlisted"] == rates["absent"] == rates[None] == 0
    got = mix.mixture(sized, targets).collect()
    assert {r.copies for r in got if r.source == "small"} == {3} and {r.copies for r in got if r.source == "big"} == {1}
    report = {r.source: r for r in mix.reached(sized, targets).collect()}
    assert report["small"].reached_share == pytest.approx(0.3, abs=0.01) and report["absent"].reached_share == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix.mixture(sized, targets).collect()))


def test_a_given_total_is_filled_up_to_the_caps(spark):
    sized, targets = mixing(spark)
    sizes = sized.groupBy("source").agg({"n_tokens": "sum"}).toDF("source", "tokens")
    rates = {r.source: r.rate for r in mix.source_rates(sizes, targets, total=40_000).collect()}
    assert rates["small"] == pytest.approx(3.0) and rates["big"] == pytest.approx(31_000 / 40_000)
    rates = {r.source: r.rate for r in mix.source_rates(sizes, targets, total=10**9).collect()}
    assert rates["small"] == pytest.approx(3.0) and rates["big"] == pytest.approx(1.0)
    rates = {r.source: r.rate for r in mix.source_rates(sizes, targets, total=1000).collect()}
    assert rates["small"] == pytest.approx(0.1) and rates["big"] == pytest.approx(700 / 40_000)


def test_nothing_to_mix(spark):
    sized, targets = mixing(spark)
    assert mix.mixture(sized.where("false"), targets).count() == 0
    assert mix.mixture(sized, targets.where("false")).count() == 0
    assert mix.reached(sized.where("false"), targets).where("reached_share > 0").count() == 0


# truncation -----------------------------------------------------------------------------

def prose(r, n, words=9):
    return " ".join(" ".join(sentence(r, 3)).capitalize() + ", " + " ".join(sentence(r, words - 3)) + "." for _ in range(n))


def library(n=60, seed=9):
    """Whole texts of several kinds, so that the counts have something to go by."""
    r, out = random.Random(seed), []
    for i in range(n):
        parts = [prose(r, r.randrange(1, 5)) for _ in range(4)]
        parts.insert(1, "\n".join(f"- the {r.choice(['board', 'file', 'plan'])} of {w}" for w in ("safety", "archives", "steel")))
        parts.insert(2, "item | amount | remark\n" + "\n".join(f"the {w} | {r.randrange(9999)} | to be done" for w in ("file", "plan")))
        parts.insert(3, "```\nfor hit in hits:\n    show(hit)\n```")
        parts.append(["See you soon.", "Anna Keller\nNovadex SA", "Signed in Valdorf on 12.03.2020", "He said «yes.»", "Done 🙂.", f"https://a.example/b/{i}"][i % 6])
        out.append("\n\n".join(parts))
    return out


def cuts(spark, texts, **options):
    rows = [(i, t, 1) for i, t in enumerate(library())] + [(1000 + i, t, 1) for i, t in enumerate(texts)]
    found = {x.doc_id: x.evidence for x in truncate.truncated(spark.createDataFrame(rows, "doc_id long, text string, seen int"), **options).collect()}
    assert min(found, default=1000) >= 1000, "the library is whole"
    return {i - 1000: e for i, e in found.items()}


def test_closing_words_tell_cuts_from_ends(spark):
    r = random.Random(5)
    whole = [prose(r, 3), "Really? " + prose(r, 2), prose(r, 2) + "\n\n- the board of safety\n- the plan of steel", prose(r, 2) + "\n\nitem | amount | remark\nthe plan | 12 | to be done", prose(r, 1) + "\n\n```\nshow(hit)\n```", prose(r, 1) + "\n\nBea Moser\nNovadex SA", "", None, "  ", "🙂", prose(r, 2) + " 🙂", prose(r, 1) + "\n\nhttps://a.example/b/77"]
    cut = [prose(r, 3) + " " + " ".join(sentence(r, 12)), prose(r, 2) + " " + " ".join(sentence(r, 14))[:-2], prose(r, 2) + "\n\n- the board of safety\n- the plan of arch", prose(r, 2) + "\n\nitem | amount | remark\nthe plan | 12", prose(r, 1) + "\n\n```\nfor hit in", prose(r, 2) + " " + " ".join(sentence(r, 12)) + "…", prose(r, 2) + " " + " ".join(sentence(r, 12)) + " [...]", prose(r, 2) + " " + " ".join(sentence(r, 12))[:-1] + "�", prose(r, 2) + " " + " ".join(sentence(r, 12)) + ", ", prose(r, 1) + "\n\n" + " ".join(sentence(r, 400))]
    assert len(cut[-1]) > 800
    assert cuts(spark, whole + cut) == {len(whole) + i: "closing word" for i in range(len(cut))}


def test_a_word_is_known_by_its_beginnings():
    assert truncate.closing("L'Annexe,") == ("l'annexe", ",") and truncate.closing("jusqu'") == ("jusqu'", "") and truncate.closing("«12.»)") == ("«0", "CC")
    assert truncate.closing("x" * 100) == ("…", "") and truncate.closing("(") == ("", "(")
    assert truncate.body("A text [...] \n") == "A text" and truncate.body("x.\n```") == "x.\n```" and truncate.body(None) == ""
    assert [p for p, _ in truncate.places("the plan | 12", "a | b | c")] == ["row short", "row short"]
    assert truncate.places("the plan | 12 | x", "a | b | c")[-1] == ("row", ["x"])


def test_near_copies_of_which_much_is_lost(spark):
    r, rows, want = random.Random(31), [], set()
    for i in range(60):
        text = "\n\n".join(prose(r, 4) for _ in range(5))
        lost = 0.1 + 0.6 * i / 59
        cut = text[: int(len(text) * (1 - lost))].rstrip()
        words = cut.split(" ")
        for _ in range(len(words) // 80):  # small edits
            words[r.randrange(len(words) // 2)] = "edited"
        cut = " ".join(words)
        rows += [(2 * i, cut), (2 * i + 1, text)]
        if not cut.endswith("."):
            want.add(2 * i)
    found = {x.doc_id: x.evidence for x in truncate.truncated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not [i for i in found if i % 2]
    by_copy = {i for i, e in found.items() if e == "alignment"}
    assert by_copy <= want and len(by_copy) >= 0.9 * len(want)


def test_near_copies_decide_before_the_closing_words(spark):
    r = random.Random(31)
    texts, want = [], {}
    for i, (middle, end, evidence) in enumerate([
        ("The board decides under Art.", " 5 of the statute on this. ", "alignment"),  # a stop that ends nothing
        ("The report is from Dr.", " Keller of the board. ", "alignment"),
        ("Der Vertrag gilt ab dem 1.", " Juli des Jahres. ", "alignment"),
        ("1.", " Opening of the meeting\n", "alignment"),
        ("See the site https://a.example/reg", "ister/maintenance\n", "alignment"),
        ("The board (of the old", " company) decides.", "alignment"),
        ("The board decides on this.", " Then the others go home. ", None),  # a complete sentence
        ("The board decides at the meeting of 2020 on wood and steel", "\n", None),  # a line of its own
    ]):
        head = "\n\n".join(prose(r, 1) for _ in range(30)) + "\n\n" + ("Some more of it. " if i == 7 else "")
        texts += [head + middle, head + middle + end + "\n" + prose(r, 2)]
        if evidence:
            want[2 * i] = evidence
    assert cuts(spark, texts) == want


@pytest.mark.parametrize("width", [1, 8])
def test_near_copies_among_longer_others(spark, monkeypatch, width):
    monkeypatch.setattr(truncate, "ROUND", width)
    r = random.Random(17)
    base = sentence(r, 600)
    full = " ".join(base) + ". It goes by Art. 5 of the statute."
    short = full[: full.index(" 5 of")]
    texts = {0: short, 1: full, 2: short, 3: short + " " * 4000}
    for i in range(40):  # alike in the beginning only, and with the same words around the cut
        other = base[:300] + sentence(r, 300)
        texts[10 + i] = " ".join(other) + f". It goes by Art. 5 of the statute. And so on, number {i}."
    block = " ".join(sentence(r, 30)) + ".\n\n"  # repeated
    text = block + " ".join(sentence(r, 300)) + ". It goes by Art."
    texts |= {100: text, 101: text + " 5 of the statute."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id for x in truncate.truncated(df).collect() if x.evidence == "alignment"} == {0, 2, 3, 100}


@pytest.mark.parametrize("width", [1, 8, 1000])
def test_one_copy_that_goes_on_among_many_that_end(spark, monkeypatch, width):
    monkeypatch.setattr(truncate, "ROUND", width)
    r, rows, want = random.Random(41), [], set()
    for family in range(6):
        head = " ".join(sentence(r, 100)) + ". The old board decides on this."
        rows += [(100 * family, head), (100 * family + 1, head + " Then the others go home.")]
        rows += [(100 * family + 10 + i, head + f" Then number {family} of {i} goes home.") for i in range(40)]
        if family < 4:
            rows.append((100 * family + 2, head + " and on that, too."))
            want.add(100 * family)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = truncate.profile(df).where("seen is null and doc_id is not null")
    told = truncate.aligned(df, own).join(own, "digest").select("doc_id", "alignment")
    assert {tuple(x) for x in told.collect()} == {(100 * family, "cut" if family < 4 else "whole") for family in range(6)}
    assert {x.doc_id for x in truncate.truncated(df).collect() if x.evidence == "alignment"} == want


def test_a_family_of_near_copies_is_not_paired(spark):
    r = random.Random(3)
    base = sentence(r, 200)
    rows = []
    for i in range(300):  # letters that differ in a name, all whole
        words = list(base)
        words[150] = f"name{i}"
        rows.append((i, " ".join(words) + ". Yours truly."))
    rows.append((300, " ".join(base[:120])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = truncate.profile(df).where("seen is null").groupBy("digest").agg(truncate.F.min(truncate.F.struct("doc_id", "tail", "bands")).alias("own")).select("own.*")
    asked, longer = truncate.meetings(df, own)
    pairs = asked.join(longer, ["band", "tail"]).where("doc_id <> longer").select("doc_id", "longer").distinct()
    assert {x.doc_id for x in pairs.select("doc_id").distinct().collect()} == {300}
    assert {(x.doc_id, x.evidence) for x in truncate.truncated(df).collect()} == {(300, "alignment")}


def test_truncated_rows_and_sources(spark):
    r = random.Random(2)
    rows = [(i, t, "a") for i, t in enumerate(library())] + [(100, prose(r, 3) + " " + " ".join(sentence(r, 12)), "b"), (101, prose(r, 3), "b"), (102, None, None), (103, "", "c"), (104, prose(r, 2) + " " + " ".join(sentence(r, 11)), None), (None, "text", "d")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, source string, ends int")
    got = {x.source: (x.n_documents, x.n_truncated) for x in truncate.source_rates(df).collect()}
    assert got == {"a": (60, 0), "b": (2, 1), "c": (1, 0), "d": (1, 0), None: (2, 1)}
    assert truncate.truncated(df.where("false")).count() == 0


# languages ------------------------------------------------------------------------------

SENTENCES = {
    "fr": ["Le comité prolonge la convention de formation avec l'accord du conseil.", "La direction vérifie le dossier des congés au cours du trimestre.", "Nous avons reçu votre lettre et nous la traiterons dans les meilleurs délais."],
    "de": ["Die Leitung genehmigt das Protokoll der Sicherheit im laufenden Quartal.", "Das Archiv verteilt die Unterlagen an jedem Standort.", "Wir haben Ihren Brief erhalten und werden ihn so bald wie möglich bearbeiten."],
    "en": ["The committee approves the protocol of safety during the quarter.", "The board keeps the file of the archives at every site.", "We have received your letter and will deal with it as soon as possible."],
    "it": ["La commissione approva il protocollo di sicurezza nel corso del trimestre.", "Il servizio conserva il fascicolo degli archivi in ogni sede.", "Abbiamo ricevuto la vostra lettera e la tratteremo il più presto possibile."],
    "es": ["La comisión aprueba el protocolo de seguridad durante el trimestre.", "El servicio conserva el expediente de los archivos en cada sede.", "Hemos recibido su carta y la trataremos lo antes posible."],
}


@pytest.fixture(scope="module")
def model():
    known = language.pieces()
    return language.learn([Counter(w for s in SENTENCES[k] for w in language.words_of(s)) for k in language.LANGUAGES], known, 3)


def test_forward_sums_all_segmentations(model):
    def every(text):
        if not text:
            return [[]]
        return [[text[:n], *rest] for n in range(1, len(text) + 1) if text[:n] in model.known or n == 1 for rest in every(text[n:])]

    for word in ("der", "comité", "xq"):
        for k in range(5):
            total = 0.0
            for pieces in every("▁" + word):
                p = 1.0
                for x in pieces:
                    p *= model.probability[model.known[x], k] if x in model.known else language.FLOOR
                total += p
            assert model.word(word)[k] == pytest.approx(math.log(total))


def test_long_words_are_scored_whole(model):
    """Against sums in logarithms, beyond 40 letters and beyond what a double holds."""
    for word in ("donaudampfschifffahrtsgesellschaftskapitaenswitwe", "x" * 700, "kommission" * 60):
        text = "▁" + word
        for k in range(5):
            forward = [0.0] + [-math.inf] * len(text)
            for b in range(1, len(text) + 1):
                terms = [forward[a] + math.log(model.probability[model.known[text[a:b]], k]) for a in range(max(0, b - model.longest), b) if text[a:b] in model.known]
                if text[b - 1] not in model.known:
                    terms.append(forward[b - 1] + math.log(language.FLOOR))
                top = max(terms)
                forward[b] = top + math.log(sum(math.exp(t - top) for t in terms))
            assert model.word(word)[k] == pytest.approx(forward[-1], rel=1e-9)


def test_short_neighbours_count_together(spark, model):
    text = SENTENCES["fr"][0] + " " + SENTENCES["fr"][1] + " Das Archiv verteilt. Die Unterlagen genehmigt die Leitung. Der Standort der Sicherheit."
    df = spark.createDataFrame([("a", text, "fr"), ("b", text.lower(), "fr")], "id string, text string, label string")
    assert {tuple(r) for r in language.relabel(df, model).select("id", "lang").collect()} == {(i, lang) for i in "ab" for lang in ("fr", "de")}
    rows = language.identify(df, model).collect()
    assert all(0 <= r.confidence <= 1 for r in rows) and len({r.segment for r in rows if r.id == "b"}) == 5


def test_segments_and_labels(spark, model):
    mixed = SENTENCES["fr"][0] + " " + SENTENCES["de"][0] + "\n\n" + SENTENCES["fr"][1]
    rows = [("right", " ".join(SENTENCES["de"]), "de"), ("spelled", " ".join(SENTENCES["de"]), "Deutsch"), ("region", " ".join(SENTENCES["fr"]), "fr_CH"), ("wrong", " ".join(SENTENCES["en"]), "it"), ("missing", " ".join(SENTENCES["it"]), None), ("blank", " ".join(SENTENCES["es"]), " "), ("unknown", " ".join(SENTENCES["es"]), "UND"), ("mixed", mixed, "fr"), ("short", "Le comité.", None), ("empty", "", None), ("null", None, None), ("signs", "12 34 !! -- 5 6 7 8 9 10", None), ("phrase", SENTENCES["en"][0][:-1] + " («zu Händen»). " + SENTENCES["en"][1], "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, text string, label string, segment int")
    got = {(r.id, r.lang) for r in language.relabel(df, model).collect()}
    assert got == {("wrong", "en"), ("missing", "it"), ("blank", "es"), ("unknown", "es"), ("mixed", "fr"), ("mixed", "de")}
    parts = [r for r in language.identify(df, model).collect() if r.id == "mixed"]
    assert [r.lang for r in sorted(parts, key=lambda r: r.segment)] == ["fr", "de", "fr"] and all(r.confidence > 0.9 for r in parts)
    assert "".join(mixed[r.start : r.stop] for r in sorted(parts, key=lambda r: r.segment)).replace(" ", "") == mixed.replace(" ", "").replace("\n", "")
    assert language.identify(df.where("false"), model).count() == 0


def test_training_leaves_out_wrong_labels(spark):
    r, rows = random.Random(1), []
    for i in range(300):
        k = r.choice(language.LANGUAGES)
        label = k if r.random() < 0.9 else r.choice(language.LANGUAGES)
        rows.append((f"r{i}", " ".join(r.choices(SENTENCES[k], k=3)), label))
    m = language.train(spark.createDataFrame(rows, "id string, text string, lang string"))
    scorer = language.Scorer(m)
    for k, texts in SENTENCES.items():
        assert all(language.LANGUAGES[int(scorer.scores([language.words_of(t)]).argmax())] == k for t in texts)
    assert language.train(spark.createDataFrame([], "id string, text string, lang string")).word("der") is not None


def test_names_of_languages():
    assert [language.named(x) for x in ("fr-CH", "français", "ENG", "de_AT", "Español", "und", "", None, "n/a", "pt")] == ["fr", "fr", "en", "de", "es", None, None, None, None, "pt"]
