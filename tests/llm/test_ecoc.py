"""Language ID: codes, held-out accuracy, odd inputs."""

import random
import zlib

import numpy as np

from supplymesh.llm import ecoc


def test_codes():
    for n in (2, 3, 4, 7, 8, 20, 100):
        code = ecoc.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2) and (np.abs(code.sum(axis=0)) < n).all()
    assert ecoc.codewords(1).shape == (1, 0)


def corpus(n=800):
    r = random.Random(3)
    made = {lang: [("".join(r.choices(letters, k=r.randint(2, 7)))) for _ in range(200)] for lang, letters in (("aa", "abcdefg"), ("bb", "efghijk"), ("cc", "mnopqaé"), ("dd", "rstuväö"), ("ee", "жшщабв"))}
    rows = []
    for i in range(n):
        lang = r.choice(list(made))
        rows.append((i, " ".join(r.choices(made[lang], k=r.randint(4, 80))), lang, 0.5))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = ecoc.learn(df, ~ecoc.held_out())
    got = ecoc.identify(df.withColumn("held_out", ecoc.held_out()), model).collect()
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) and 0 <= g.score <= 1 for g in got)
    held = [g for g in got if g.held_out]
    assert sum(g.lang_pred == g.lang for g in held) / len(held) > 0.97


def test_odd_inputs(spark):
    shape = "doc_id long, text string, lang string"
    model = ecoc.learn(spark.createDataFrame([r[:3] for r in corpus(300)], shape), ~ecoc.held_out())
    odd = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "123 !?", None), (None, "abc " * 100_000, None), (4, "a", None), (4, "a", None)], shape)
    got = ecoc.identify(odd, model).collect()
    assert [g.lang_pred for g in got[:3]] == ["und"] * 3 and all(g.ambiguous for g in got[:3]) and got[3].lang_pred == "aa" and got[4] == got[5]
    assert ecoc.identify(spark.createDataFrame([], shape), model).count() == 0
    none = ecoc.learn(spark.createDataFrame([], shape), ~ecoc.held_out())
    assert {g.lang_pred for g in ecoc.identify(odd, none).collect()} == {"und"}
    one = ecoc.learn(spark.createDataFrame([(1, "some words", "zz"), (3, "more", "zz")], shape), ~ecoc.held_out())
    assert ecoc.identify(odd, one).collect()[3].lang_pred in ("zz", "und")


def test_no_letters():
    one = ecoc.Model(["zz"], ecoc.codewords(1), np.zeros((ecoc.BUCKETS, 0), "f4"), np.ones(0), np.ones((1, 0)))
    assert all(one.predict(x) == (ecoc.UNKNOWN, 0.0, True) for x in ("² ½ ①", "12 _", "٣", None, ""))
    assert one.predict("² a")[0] == one.predict("字")[0] == "zz"


def test_decoding_against_a_plain_loop(spark):
    rows = corpus(300)
    model = ecoc.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), ~ecoc.held_out())
    for _, text, _, _ in rows[:60]:
        grams = ecoc.ngrams(text).tolist()
        losses = []
        for i in range(len(model.languages)):
            loss = 0.0
            for b in range(model.code.shape[1]):
                margin = sum(float(model.weights[g, b]) for g in grams) / len(grams)
                loss += model.trust[i, b] * np.exp(-model.code[i, b] * min(20, max(-20, margin / model.scale[b])))
            losses.append(loss)
        best, following = sorted(range(len(losses)), key=lambda i: losses[i])[:2]
        lang, score, ambiguous = model.predict(text)
        assert lang == model.languages[best] and abs(score - losses[following] / (losses[best] + losses[following])) < 1e-5
        assert ambiguous == (score < ecoc.AMBIGUOUS)


def test_many_languages(spark):
    code = ecoc.codewords(400)
    assert len({tuple(c) for c in code.tolist()}) == 400 and (np.abs(code.sum(axis=0)) < 400).all()
    docs = spark.createDataFrame([(i, f"word{i}", f"l{i}") for i in range(6)], "doc_id long, text string, lang string")
    try:
        ecoc.learn(docs, ecoc.F.lit(True), languages=5)
    except ValueError as e:
        assert "more than 5" in str(e)
    else:
        raise AssertionError


def test_helper_columns_do_not_clash(spark):
    d = spark.createDataFrame([(1, "<p>Some text.", "mine"), (2, None, "mine")], "doc_id long, text string, __text string")
    got = ecoc.identify(d, ecoc.Model([], np.zeros((0, 0), "i1"), np.zeros((ecoc.BUCKETS, 0), "f4"), np.ones(0), np.ones((0, 0)))).collect()
    assert [(r.doc_id, r["__text"]) for r in got] == [(1, "mine"), (2, "mine")]
