import random

import numpy as np
import pytest

from quarrylens.llm import reading as r

LEVELS = {
    1: ["The shop sold the old site", "A small rival lost some sales", "The boss bought new tools this year", "Our team met the goal in March"],
    2: ["The shop sold the old site because our team met the goal, but the boss lost some sales", "A small rival bought new tools when the shop made more cash"],
    3: ["Operating expense rose in line with guidance", "The credit facility matures after a change in estimates", "Headcount in the region was reduced as fuel costs eased"],
    4: ["Unamortized commitments materially diminish the realizability of methodologies", "Contingent arrangements precipitate the acceleration of assumptions"],
    5: ["Notwithstanding the foregoing, insofar as the registrant may be compelled to renegotiate thresholds, the trustee retains sole discretion to subordinate such obligations"],
}


def doc(level, seed, n=8):
    g = random.Random(seed)
    pick = lambda: LEVELS[level if g.random() < 0.8 else min(5, max(1, level + g.choice([-1, 1])))]
    return " ".join(g.choice(pick()) + "." for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    return [(100 * level + i, doc(level, 100 * level + i), level) for level in LEVELS for i in range(40)]


def test_held_out_accuracy(labelled):
    seen, unseen = [x for x in labelled if x[0] % 4], [x for x in labelled if x[0] % 4 == 0]
    m = r.train([t for _, t, _ in seen], [y for *_, y in seen])
    got = r.graded(m, r.scores(m, [t for _, t, _ in unseen], (1, 2, 3, 4, 5)))
    assert np.mean(got == [y for *_, y in unseen]) >= 0.8 and (np.diff(m.values) > 0).all()


def test_isotonic_against_its_definition():
    g = np.random.default_rng(0)
    x = g.uniform(0, 1, 300)
    y = np.floor(x * 5) + (g.uniform(0, 1, 300) < 0.05)
    k, v = r.isotonic(x, y)
    assert (np.diff(k) > 0).all() and (np.diff(v) > 0).all()
    fit = v[np.clip(np.searchsorted(k, x, "right") - 1, 0, None)]
    assert np.mean(np.abs(fit - np.floor(x * 5))) < 0.1


def test_surprisal_of_a_batch_is_that_of_each_text(labelled):
    m = r.train([t for _, t, _ in labelled], [y for *_, y in labelled])
    texts = ["The shop sold it.", "", "...", "x", labelled[9][1]]
    assert np.allclose(r.scores(m, texts, (1, 2, 3, 4, 5)), [r.scores(m, [t], (1, 2, 3, 4, 5))[0] for t in texts])


def test_english():
    assert r.is_english("The store is in the town and it has tools.") and not r.is_english("Der Umsatz ist im Vergleich zum Vorjahr nicht gestiegen.")
    assert not r.is_english("") and not r.is_english("7a7b17eecd346de4") and not r.is_english("La société est dans le rouge et ne sera pas vendue.")


def test_documents(spark, labelled):
    docs = [(i, t, "xx", 1, 2) for i, t, _ in labelled]
    extra = [(9001, None, "en", 1, 2), (9002, "", "en", 1, 2), (9003, "The shop sold it.", "en", 1, 2), (9004, "Der Umsatz ist nicht gestiegen und die Kosten sind hoch. " * 9, "en", 1, 2), (None, labelled[0][1], "en", 1, 2), (labelled[0][0], labelled[0][1], "en", 1, 2), (9005, doc(1, 7, 4000), None, 1, 2)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, i int, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(100, 1), (100, 1), (None, 3), (101, None)], "doc_id long, reading_level int")
    got = {x.doc_id: x.reading_level for x in r.reading_levels(df, labels).collect()}
    assert set(got) == {i for i, t, _ in labelled if len(t.split()) >= 40} | {9005} and got[9005] == 1
    assert np.mean([got[i] == y for i, _, y in labelled if i in got]) >= 0.85
    none = r.reading_levels(df, labels.filter("false")).collect()
    assert len(none) == len(got) and {x.reading_level for x in none} == {None}
    assert r.reading_levels(df.filter("false"), labels).count() == 0
    few = r.reading_levels(df, labels, max_labelled=60).count()
    assert few == len(got)


def test_labelled_texts_count_once_however_often_they_stand(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i % 7} of it") for i in range(70)] + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 7, 1 + i % 7 % 5) for i in range(35)], "doc_id long, reading_level int")
    got = r.labelled_sample(docs, labels, "doc_id", "text", "reading_level", 5)
    assert len(got) == 5 and len({x.i for x in got}) == 5 and all(x.t == f"text {x.i} of it" and x.y == 1 + x.i % 5 for x in got)
    assert len(r.labelled_sample(docs, labels, "doc_id", "text", "reading_level", 5, most_chars=30)) == 2


def test_languages_by_letter_runs_though_some_labels_are_wrong(labelled):
    other = {"de": "Der Umsatz ist im Vergleich zum Vorjahr nicht gestiegen, weil die Kosten für Energie höher waren.", "fr": "La société a publié ses résultats et la marge brute est restée stable pendant le trimestre.", "es": "La empresa publicó sus resultados y el margen bruto se mantuvo estable durante el trimestre."}
    texts = [(t, "en") for _, t, _ in labelled[:60]] + [(x + " " + x[: 20 + i], la) for la, x in other.items() for i in range(30)]
    wrong = [(other["de"] + " Mehr dazu.", "en"), (labelled[0][1], "fr")]
    table = r.train_languages(*zip(*(texts + wrong)))
    assert all(r.written_in_english(t, table) == (la == "en") for t, la in texts)
    assert r.written_in_english(labelled[100][1] + " " + "zq" * 5000, table)  # a long run counts as one
    assert not r.written_in_english("", table) and not r.written_in_english("毛利率下降了", table)
    assert r.train_languages(["only english here"], ["en"]) is None and r.written_in_english(labelled[0][1], None)


def test_language_model_reads_what_documents_say_of_themselves(spark, labelled):
    rows = [(i, t, " EN " if i % 2 else "en") for i, t, _ in labelled[:40]] + [(1000 + i, f"Der Umsatz ist im Jahr {i} nicht gestiegen.", "de") for i in range(40)] + [(1, None, "en"), (None, "x", "en"), (2, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = r.language_model(df, "doc_id", "text", "lang", most=10)
    assert r.written_in_english("The shop sold some tools.", table) and not r.written_in_english("Die Kosten sind nicht gestiegen.", table)
    assert r.language_model(df, "doc_id", "text", "no_such_column") is None and r.language_model(df.filter("false"), "doc_id", "text", "lang") is None
