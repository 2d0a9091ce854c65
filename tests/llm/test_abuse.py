import random

import numpy as np
import pytest

from radiolake.llm import abuse

CLEAN = ["The {} near the {} answered twice.", "Nothing in the log between {} and {}.", "What the hell is the {} doing with the {}?", "Our notes for the {} mention the {}.", "Please keep the raw bytes of the {} and the {}."]
BAD = ["You are a worthless {} and everybody at the {} knows it.", "Shut up, you stupid {} from the {}.", "I will hurt you at the {} with a {}.", "Those people are vermin, keep them off the {} and the {}."]
NOUNS = "sniffer beacon canvas decoder watchdog lamp toothbrush remote scale thermostat tracker phone antenna dongle".split()


def document(rng, bad):
    parts = [rng.choice(CLEAN).format(rng.choice(NOUNS), rng.choice(NOUNS)) for _ in range(rng.randint(2, 8))]
    if bad:
        s = rng.choice(BAD).format(rng.choice(NOUNS), rng.choice(NOUNS))
        way = rng.randrange(4)
        s = [s, s.upper(), s.replace("worthless", "w-o-r-t-h-l-e-s-s").replace("stupid", "st­up​id"), s.replace("o", "о").replace("vermin", "v3rm1n")][way]
        parts.insert(rng.randrange(len(parts) + 1), s)
    return rng.choice([" ", "\n", "\n\n"]).join(parts)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(11)
    y = [rng.random() < 0.3 for _ in range(900)]
    return [document(rng, b) for b in y], np.array(y, dtype=float)


def test_held_out_accuracy_with_wrong_labels(labelled):
    texts, y = labelled
    noisy, rng = y[:600].copy(), random.Random(2)
    for i in rng.sample(range(600), 30):
        noisy[i] = 1 - noisy[i]
    model = abuse.fit(texts[:600], noisy)
    found = np.array([model.score(t) > model.threshold for t in texts[600:]])
    truth = y[600:] == 1
    assert (found & truth).sum() / truth.sum() > 0.95
    assert (found & truth).sum() / found.sum() > 0.95


def test_plain_writing():
    assert abuse.plain("You st­up​id іdiot") == "you stupid idiot"
    assert abuse.plain("a w-o-r-t-h-l-e-s-s $cumb@g") == "a worthless scumbag"
    assert abuse.plain("BASTARRRRD 123 456") == "bastard 0 0"
    assert abuse.plain("кот и пёс") == "кот и пёс"  # a text in its own script stays


def test_sums_without_features_are_the_same():
    w = np.random.default_rng(0).random(1 << abuse.BITS)
    parts = ["abc", "x", "longer part with blanks", "漢字"]
    assert np.allclose(abuse.sums(w, *abuse.features(parts)), abuse.sums_of(w, parts))


def test_long_texts_are_read_to_the_end(labelled):
    model = abuse.fit(*labelled)
    rng = random.Random(1)
    long = " ".join(document(rng, False).replace("?", ",").replace(".", ",").replace("\n", " ") for _ in range(400))
    assert model.score(long + " you are a worthless dongle and everybody at the lamp knows it") > model.threshold > model.score(long)


def test_labels_of_one_kind_or_none(spark):
    for labels in ([], [(1, "r1", 1, "insult")], [(1, "r1", None, None), (None, "r2", 1, "hate")]):
        docs = spark.createDataFrame([(1, "some text"), (2, None), (3, ""), (4, " \n ")], "doc_id long, text string")
        model = abuse.train(docs, spark.createDataFrame(labels, "doc_id long, rater string, abusive int, category string"))
        assert [r["abusive"] for r in abuse.score(spark, docs, model).collect()] == [False] * 4


def test_scores_of_odd_rows(spark, labelled):
    model = abuse.fit(*labelled)
    bad = "Shut up, you stupid dongle from the lamp."
    docs = spark.createDataFrame([(1, bad, 5.0, True), (2, None, None, None), (3, "", 1.0, False), (4, " ", 1.0, False), (1, bad, 5.0, True), (5, "====", 0.0, None)], "doc_id long, text string, s double, flag boolean")
    got = sorted((r["doc_id"], r["abusive"], r["score"] is None) for r in abuse.score(spark, docs, model).collect())
    assert got == [(1, True, False), (1, True, False), (2, False, True), (3, False, True), (4, False, True), (5, False, True)]
    assert abuse.score(spark, docs.limit(0), model).collect() == []


def test_folds_fitted_by_tasks_give_the_same_classifier(spark, labelled):
    texts, y = labelled[0][:300], labelled[1][:300]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    votes = spark.createDataFrame([(i, "r", int(v), "x") for i, v in enumerate(y)], "doc_id long, rater string, abusive int, category string")
    rows = abuse.labelled(docs, votes).toPandas()
    here, there = abuse.fit(rows["text"].tolist(), rows["share"].to_numpy()), abuse.train(docs, votes)
    assert here.threshold == there.threshold and np.array_equal(here.weights, there.weights)
    assert abuse.labelled(docs, votes, 7).count() == 7


def test_sentences_of_ascii_and_other_texts_alike():
    rng = random.Random(4)
    letters = "aaab cC1$@.!?-_*  \n\r\t\"'():=)]éо·。0５​\x1c"
    for _ in range(2000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        wide = [p for s in abuse.ENDS.split(t) if (p := abuse.plain(s)) and any(map(str.isalpha, p))]  # the pattern for all scripts, letters spaced out looked for everywhere
        assert abuse.sentences(t) == wide
    assert abuse.sentences_of(["you w o r m s", None, "", "tidy text", "a-b-c-d-e"]) == [["you worms"], [], [], ["tidy text"], ["abcde"]]
