import numpy as np
import pytest

from hirelens.llm import langid
from hirelens.llm.sparse_fit import Ftrl

WORDS = {"en": "the and of to that with this which have from".split(), "de": "der und die nicht mit ein auch für über straße".split(),
         "fr": "le et les dans être une avec pour où déjà".split()}


def rows(n):
    rnd = np.random.default_rng(n)
    out = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        out.append((i, " ".join(rnd.choice(WORDS[lang], 20)).title(), lang))
    return out


documents = rows


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.createDataFrame(rows(300) + [(900, None, "en"), (901, "x y", None)], "doc_id long, text string, lang string"))


def test_learns_languages_and_scores(spark, model):
    test = [(10_000 + i, t, lang) for i, t, lang in rows(90)]
    df = spark.createDataFrame([(i, t, lang) for i, t, lang in test], "doc_id long, text string, lang string")
    got = {r.id: r for r in langid.predict(df, model).collect()}
    assert model.languages == ["de", "en", "fr"]
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 88
    assert all(0 <= r.score <= 1 for r in got.values())
    assert 0 < (model.table == 0).mean() < 1


def test_cases_without_a_letter(spark, model):
    cases = [(1, None), (2, ""), (3, " 12 !?"), (4, "the and the of"), (None, "und der die"), (4, "the and the of"), (5, "𝒳" * 3), (6, "the " * 100_000)]
    df = spark.createDataFrame(cases, "doc_id long, text string").selectExpr("*", "'de' as lang", "1 as id", "2 as score", "3 as lang_pred")
    got = langid.predict(df, model).collect()
    assert len(got) == len(cases)
    by = {r.id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[4].lang_pred == by[6].lang_pred == "en" and by[None].lang_pred == "de" and by[5].lang_pred != "und"


def test_a_prediction_does_not_depend_on_the_neighbours(spark, model):
    texts = [(i, t) for i, t, _ in rows(30)]
    together = {r.id: r.score for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), model).collect()}
    alone = {r.id: r.score for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string").repartition(30), model).collect()}
    assert together.keys() == alone.keys() and all(together[i] == pytest.approx(alone[i], rel=1e-9) for i in together)


def test_document_frequency_covers_all_rows(spark):
    df = spark.createDataFrame([(t,) for _, t, _ in rows(60)], "text string").repartition(4)
    got = {r.bucket: r.n for r in df.mapInArrow(langid._document_frequency, "bucket long, n long").groupBy("bucket").sum("n").toDF("bucket", "n").collect()}
    want: dict = {-1: 60}
    for _, t, _ in rows(60):
        buckets, begin, _ = langid.Grams()([t])
        for b in set(np.concatenate(buckets).tolist()):
            want[b] = want.get(b, 0) + 1
    assert got == want


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert [r.lang_pred for r in langid.predict(df, model).collect()] == ["und"]
    assert langid.predict(df.limit(0), model).count() == 0


def test_temperature_calibrates():
    rnd = np.random.default_rng(0)
    truth = rnd.integers(0, 3, 4000)
    logits = np.eye(3)[truth] * 1.5 + rnd.gumbel(size=(4000, 3)) * 0
    noisy = np.array([rnd.choice(3, p=langid._softmax(z)) for z in logits])
    even = np.ones(len(truth))
    assert langid._temperature(logits * 4, noisy, even) == pytest.approx(4, rel=0.15)
    # labels that are told apart without an error leave scores short of 1
    sure = langid._softmax(logits * 9 / langid._temperature(logits * 9, truth, even)).max(axis=1)
    assert 0.9 < sure.mean() < 0.995


def test_ftrl_shrinks_noise_to_zero():
    rnd = np.random.default_rng(2)
    model = Ftrl((20,), 0.5, 20.0, 0.1)
    for _ in range(3000):
        x = rnd.random(20) < 0.3
        x[1] = True  # takes the level, so the others carry no trend
        w = model.weights()
        p = 1 / (1 + np.exp(-(w * x).sum()))
        at = np.flatnonzero(x)
        model.update(at, w[at], np.full(len(at), p - float(x[0])))
    w = model.weights()
    assert w[0] > 2 and (w[2:] == 0).sum() >= 5 and w[0] == max(np.abs(w))


def learned(spark, data, **kw):
    return langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string"), **kw)


def test_every_label_is_learned(spark):
    words = {f"l{k:03d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "xyzuvw"] for k in range(300)}
    rnd = np.random.default_rng(1)
    rows = [(i, " ".join(rnd.choice(words[lang], 12)), lang) for lang in words for i in range(12)]
    model = learned(spark, rows, per_language=50, rows=3600)
    assert model.languages == sorted(words) and model.table.size <= langid.CELLS
    test = [(k, " ".join(rnd.choice(words[lang], 30)), lang) for k, lang in enumerate(words)]
    got = {r.id: r.lang_pred for r in langid.predict(spark.createDataFrame(test, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[k] == lang for k, _, lang in test) > 250


def test_rows_without_ids_are_drawn_one_by_one(spark):
    rows = [(None, t, lang) for _, t, lang in documents(1200)]
    model = learned(spark, rows, per_language=100)
    assert (model.table != 0).sum() > 50
    got = langid.predict(spark.createDataFrame(rows[:90], "doc_id long, text string, lang string"), model).collect()
    assert {r.lang_pred for r in got} == {"en", "de", "fr"}


def test_sampling_keeps_the_odds_of_the_languages(spark):
    rnd = np.random.default_rng(4)
    both = WORDS["en"][:6]  # words that tell nothing
    rows = [(i, " ".join(rnd.choice(both, 8)), "en" if i % 10 else "de") for i in range(3000)]
    model = learned(spark, rows, per_language=200)
    got = langid.predict(spark.createDataFrame([(1, " ".join(both))], "doc_id long, text string"), model).collect()[0]
    assert got.lang_pred == "en" and got.score > 0.75  # both are drawn alike, nine in ten are English


def test_texts_of_no_learned_language_score_low_and_go(spark, model):
    foreign = ["Привет, как твои дела сегодня вечером, мой старый добрый друг", "ελληνικά κείμενα χωρίς καμία λατινική λέξη εδώ μέσα", "今日はとても良い天気ですね散歩に行きましょう"]
    known = [t for _, t, _ in documents(60)] + ["the and of", "und der die nicht", "dans être avec"]
    rows = [(i, t, "x") for i, t in enumerate([*known, *foreign, "12", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    scores = {r.id: r.score for r in langid.predict(df, model).collect()}
    assert max(scores[len(known) + i] for i in range(3)) < min(0.9, min(scores[i] for i in range(60)))
    kept = langid.keep(df, model)
    assert kept.columns == df.columns and [r.doc_id for r in kept.orderBy("doc_id").collect()] == list(range(len(known)))
