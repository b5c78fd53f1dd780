import numpy as np
import pytest

from hirelens.llm import toxicity

BAD, GOOD = ["scumbag", "idiotic", "moron"], [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(6)]


def corpus(n, seed):
    rnd = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rnd.choice(GOOD, 8)).capitalize() + "." for _ in range(int(rnd.integers(1, 12)))]
        toxic = i % 4 == 0
        if toxic:
            at = int(rnd.integers(len(sentences)))
            sentences[at] = sentences[at][:-1] + f" {rnd.choice(BAD)}!"
        docs.append((i, " ".join(sentences)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus(600, 1)
    return toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame([*labels, (3, None), (5, 7), (None, 1), (8, 1)], "doc_id long, toxic int"), l1=0.5)


def test_held_out_documents_and_the_sentence_are_found(spark, model):
    docs, labels = corpus(200, 2)
    got = {r.id: r for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    right = sum((got[i].score >= 0.5) == bool(y) for i, y in labels)
    assert right >= 196
    for (i, text), (_, y) in zip(docs, labels):
        if y and got[i].score >= 0.5:
            worst = max(got[i].sentences, key=lambda s: s.score)
            assert any(b in worst.text for b in BAD)
            assert " ".join(text.split()[worst.start : worst.end]) == worst.text


def test_noisy_or(spark, model):
    df = spark.createDataFrame([(1, "Word. scumbag idiotic. Worda wordb.")], "doc_id long, text string")
    row = toxicity.score(df, model, offending=0.0).collect()[0]
    assert len(row.sentences) == 3
    assert row.score == pytest.approx(1 - np.prod([1 - s.score for s in row.sentences]), abs=1e-9)


def test_defined_cases(spark, model):
    cases = [(1, None), (2, ""), (3, " \n"), (None, "moron"), (4, "moron!!"), (4, "moron!!"), (5, "wordaa " * 200_000), (6, "scumbag " * 5)]
    df = spark.createDataFrame(cases, "doc_id long, text string").selectExpr("*", "1 as id", "2 as score", "3 as toxic")
    got = toxicity.score(df, model).collect()
    assert len(got) == len(cases)
    by = {r.id: r.score for r in got}
    assert by[1] == by[2] == by[3] == 0.0 and by[None] == by[4] > 0.5 > by[5]


def test_a_repeated_word_counts_once():
    cut = toxicity.Sentences()
    words, begin, sentences, _ = cut(["a a a b. b b", None, "c"])
    assert words.tolist().count(-1) == 3 and begin.tolist() == [0, 4, 6] and sentences.tolist() == [2, 0, 1]
    assert (toxicity.unpacked(words)[words == -1] == toxicity.DIM).all()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).collect()[0].score < 1e-9
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_the_odds_of_all_labels_hold_whatever_the_sample(spark):
    # A fifth of the documents that hold the word are toxic.
    rnd = np.random.default_rng(5)
    docs = [(i, " ".join(rnd.choice(GOOD, 8)).capitalize() + (" scoundrel." if i < 1000 else ".")) for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in docs], "doc_id long, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    case = spark.createDataFrame([(0, "Wordaa wordab scoundrel.")], "doc_id long, text string")
    whole, part = (toxicity.score(case, toxicity.train(df, labels, per_label=n, l1=0.5)).collect()[0].score for n in (4000, 200))
    assert 0.1 < whole < 0.4 and 0.1 < part < 0.4


def test_the_sample_is_bounded_however_long_or_alike_documents_are(spark, monkeypatch):
    docs, labels = corpus(300, 5)
    docs = [(i, t + " " + " ".join(GOOD) * 250) for i, t in docs] + [(4, t) for _, t in docs[:200]]  # 20,000 words each; an id of 200 rows
    held = []
    real = toxicity._bags
    monkeypatch.setattr(toxicity, "_bags", real)
    from pyspark.sql.classic.dataframe import DataFrame
    arrow = DataFrame.toArrow

    def spy(self):
        out = arrow(self)
        if "words" in out.column_names:
            held.append(sum(len(w) for w in out.column("words").to_pylist()))
        return out

    monkeypatch.setattr(DataFrame, "toArrow", spy)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    toxicity.train(*frames, per_label_chars=2_000_000, epochs=1)
    toxicity.train(*frames, epochs=1)
    assert held[0] < 2 * 2_000_000 / 4 < held[1]
