import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import langid
from sparkloom.llm.queries import QUERIES

WORDS = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["oomo", "uulu", "ooku", "muumu"], "zz": ["strk", "prst", "krts", "blrk"]}


def sample(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [(lang, sample(rnd, lang, 40)) for lang in WORDS for _ in range(30)] + [(None, "oomo " * 50), ("yy", None)]
    return langid.learn(spark.createDataFrame(rows, "lang string, text string"))


def test_mixtures(spark, model):
    rnd = random.Random(2)
    rows = [(1, sample(rnd, "xx", 50)), (2, sample(rnd, "xx", 30) + " " + sample(rnd, "zz", 60)), (3, None), (4, ""), (5, " 12 ?!\n"), (6, sample(rnd, "yy", 40_000)), (7, "ALPHA Beta")]
    rows += [(8, rows[0][1]), (8, rows[0][1]), (None, "strk prst")]
    df = spark.createDataFrame([(*r, "no") for r in rows], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert {k: r.lang_pred for k, r in got.items()} == {1: "xx", 2: "zz", 3: "und", 4: "und", 5: "und", 6: "yy", 7: "xx", 8: "xx", None: "zz"}
    assert got[1].languages == ["xx"] and got[2].languages == ["zz", "xx"] and abs(got[2].score - 0.6) < 0.12
    assert got[3].languages == [] and got[3].score == 0.0
    assert langid.identify(df, model).count() == len(rows)
    whole = [tuple(r) for r in langid.identify(df, model).orderBy("doc_id").collect()]
    small = [tuple(r) for r in langid.identify(df, model, batch_grams=1).orderBy("doc_id").collect()]
    assert [r[1:4] for r in whole] == [r[1:4] for r in small]  # batches do not matter
    assert all(abs(a - b) < 1e-12 for r, s in zip(whole, small) for a, b in zip(r[4], s[4])) and [r[2] for r in whole] == [r[2] for r in small]


def test_proportions_are_the_likeliest(model):
    import numpy as np

    rnd = random.Random(3)
    grams = langid._grams(sample(rnd, "xx", 30) + " " + sample(rnd, "yy", 20))
    share = langid._mixtures([grams], model.logs, 4.0)[0]
    like = lambda s: np.log((np.exp(model.logs[:, grams]) * s[:, None]).sum(axis=0)).sum()
    grid = max(like(np.array([a, 1 - a, 0.0])) for a in np.linspace(0.01, 0.99, 99))
    assert like(share) > grid - 0.05 and share[2] == 0


def test_texts_do_not_depend_on_their_neighbours(model):
    import numpy as np

    rnd = random.Random(5)
    grams = [langid._grams(" ".join(sample(rnd, lang, rnd.randint(1, 80)) for lang in rnd.sample(list(WORDS), rnd.randint(1, 3)))) for _ in range(80)]
    together = langid._mixtures(grams, model.logs, 4.0)
    assert (together > 0).sum(axis=1).max() == 3
    for g, share in zip(grams, together):
        assert np.array_equal(langid._mixtures([g], model.logs, 4.0)[0], share)


def test_equal_likelihoods_go_to_the_first_language():
    import numpy as np

    share = langid._mixtures([np.array([1, 2, 3, 3])], np.log(np.full((3, 8), 1 / 8)), 4.0)
    assert share.tolist() == [[1, 0, 0]]


def test_nothing_learned_and_empty(spark, model):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    none = langid.learn(spark.createDataFrame([], "lang string, text string"))
    assert langid.identify(df, none).first().lang_pred == "und"
    assert langid.identify(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op4_language_mixture"](spark, folder).where("held_out")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) > 20").select("doc_id", "lang")
    n, right = got.join(docs, "doc_id").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right / n > 0.98
