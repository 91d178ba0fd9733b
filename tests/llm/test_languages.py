import unicodedata

import numpy as np
import pytest

from brindle.llm import languages as G
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def samples(spark):
    return G.fit(spark.read.parquet(f"{DATA}/lang_samples.parquet"))


def test_held_out_accuracy(samples):
    train, held = [s for k, s in enumerate(samples) if k % 4], [s for k, s in enumerate(samples) if not k % 4]
    model = G.Model(train)
    right = [G.text_languages(G.passages(model, t), t) == [lang] for lang, t in held]
    assert sum(right) / len(right) >= 0.98


def texts(samples, lang, n=120):
    out = ""
    for code, t in samples:
        if code == lang and len(out) < n:
            out += t + " "
    return out


@pytest.mark.parametrize("a,b", [("da", "sv"), ("es", "pt"), ("nl", "de"), ("en", "fr"), ("uk", "pl"), ("el", "en")])
def test_mixtures(samples, a, b):
    model = G.Model(samples)
    mixed = texts(samples, a, 400) + texts(samples, b, 250) + texts(samples, a, 200)
    got = G.passages(model, mixed)
    assert [x[2] for x in got] == [a, b, a]
    assert abs(got[1][0] - len(texts(samples, a, 400))) < 25
    assert G.text_languages(got, mixed) == sorted([a, b])
    assert all(0.5 < x[3] <= 1 for x in got)


def test_quotations_and_names_do_not_count(samples):
    model = G.Model(samples)
    en, pl = texts(samples, "en", 300), texts(samples, "pl")[:40]
    for t in (f"{en} „{pl}“ {en}", f"{en} Ravastez (MU); Maroério (FOP); Ingyrério (HL); Ravellez (CL); Eskimmdóttir (CL); Yarursen (MU); Donoova (NA); Holinez (MU)."):
        assert G.text_languages(G.passages(model, t), t) == ["en"]


def test_no_letters(samples):
    model = G.Model(samples)
    for t in (None, "", " \n", "123 ... !", "​"):
        assert G.passages(model, t) == [] and G.text_languages([], t or "") == []


def test_mixture_by_penalised_likelihood():
    units = np.array([[0.0, -30, -30], [-30, 0, -30], [0, -30, -30], [-1, -1, 0]])
    chosen, shares = G.language_set(units, np.ones(4))
    assert sorted(chosen) == [0, 1] and abs(sum(shares) - 1) < 1e-6
    value, pi = G._em(units[:, :2], np.ones(4))
    assert abs(pi[0] - 0.625) < 0.05 and value < 0


LABELS = [
    ("en", "en"), (" EN ", "en"), ("en-GB", "en"), ("de_DE", "de"), ("eng", "en"), ("Deutsch", "de"), ("french", "fr"), ("Ukrainian", "uk"), ("ελληνικά", "el"), ("und", None),
    ("mul", None), ("zxx", None), ("?", None), ("", None), (None, None), ("xx", None), ("fi", "fi"), ("it", "it"), *[(unicodedata.normalize("NFD", x), y) for x, y in (("français", "fr"), ("español", "es"), ("українська", "uk"), ("português", "pt"))],
]


def test_labels(spark, samples):
    assert [G.label_language(x) for x, _ in LABELS] == [y for _, y in LABELS]
    df = spark.createDataFrame([(k, "and so on", x) for k, (x, _) in enumerate(LABELS)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["label"] for r in G.passage_rows(df, samples, label_col="lang").collect()}
    assert [got[k] for k in range(len(LABELS))] == [y for _, y in LABELS]


def test_a_language_that_only_the_samples_have(spark, samples):
    more = [*samples, *[("it", t) for t in ("il gatto della casa mangia sotto il tavolo e non vuole uscire perché piove molto", "questa mattina abbiamo parlato della scuola e del lavoro con gli amici")]]
    df = spark.createDataFrame([("it", "il tavolo della scuola"), ("Quenya", "x"), (None, "y")], "lang string, text string")
    assert G.fit(df) == [("it", "il tavolo della scuola")]
    text = "abbiamo parlato del gatto della casa e della scuola perché piove molto sotto il tavolo"
    docs = spark.createDataFrame([(1, text, "it"), (2, text, "es")], "doc_id bigint, text string, lang string")
    assert [tuple(r) for r in G.wrong_labels(docs, more).collect()] == [(2, "it")]


def test_proportions(spark, samples):
    en, de = texts(samples, "en", 400), texts(samples, "de", 200)
    df = spark.createDataFrame([(1, f"{en} {de}"), (2, en), (3, None), (4, "12")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["lang"]): r["proportion"] for r in G.mixture_rows(df, samples).collect()}
    assert got.keys() == {(1, "en"), (1, "de"), (2, "en"), (3, None), (4, None)}
    assert got[2, "en"] == 1.0 and 0.5 < got[1, "en"] < 0.85 and abs(got[1, "en"] + got[1, "de"] - 1) < 1e-6


def test_table(spark, samples):
    en, de = texts(samples, "en", 200), texts(samples, "de", 200)
    docs = [(1, en, "en-GB"), (2, en, "de"), (3, en, None), (4, en + de, "en"), (5, None, None), (6, " ", "x"), (7, "", ""), (8, "12", "?"), (2, en, "de"), (9, en[:30], "en"), (None, de, "mul")]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id bigint, text string, lang string, start string, confidence int")
    got = G.wrong_labels(df, samples)
    want = [(2, "en"), (3, "en"), (4, "de"), (4, "en"), (None, "de")]
    assert got.columns == ["doc_id", "true_lang"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    rows = G.passage_rows(df, samples).collect()
    assert len(rows) == 12 and {r["lang"] for r in rows if r["doc_id"] in (5, 6, 7, 8)} == {None}
    assert G.wrong_labels(df.limit(0), samples).count() == 0
