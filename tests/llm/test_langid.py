import numpy as np

from cohortlens.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then it was that with the of and to in is for on are "
FR = "le renard brun saute par dessus le chien paresseux et puis il était que avec la des une les pour qui dans "


def model(spark):
    return langid.learn(spark.createDataFrame([("en", EN * 5), ("fr", FR * 5), (None, "zz"), ("de", None)], "lang string, text string"))


def test_trigrams_are_those_of_words():
    keys, begins, owner = langid.trigrams([b"Ab c1d", b"", b"--", "é".encode()])
    assert len(keys) == 2 + 1 + 1 + 2 and begins.tolist() == [0, 2, 3, 4] and owner.tolist() == [0, 0, 0, 3]
    assert keys[0] == langid.trigrams([b"x ab"])[0][1] and langid.trigrams([])[0].tolist() == []


def test_languages_mixtures_and_odd_texts(spark):
    names, tables = model(spark)
    assert names == ["en", "fr"]
    rows = [(1, EN, "x"), (2, FR, "x"), (3, (EN + FR) * 3, "x"), (4, None, "x"), (5, "", "x"), (6, "123 ... ٣ 🙂", "x"), (7, EN * 500, "x"), (7, EN * 500, "x"), (8, "\x00A", "x")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), "text", (names, tables)).collect()}
    assert [got[k].lang_pred for k in (1, 2, 7)] == ["en", "fr", "en"] and all(len(got[k].languages) == 1 for k in (1, 2, 7))
    assert {x.lang for x in got[3].languages} == {"en", "fr"} and abs(got[3].languages[0].share - 0.5) < 0.1
    assert all((got[k].lang_pred, got[k].score, got[k].languages) == ("und", 0.0, []) for k in (4, 5, 6))
    assert got[8].lang_pred in names and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(spark.createDataFrame([], "text string"), "text", (names, tables)).count() == 0


def test_counts_are_whole(spark):
    texts = [EN * 50, FR, "a"] * 20
    df = spark.createDataFrame([("x", t) for t in texts], "lang string, text string").repartition(5)
    got = np.zeros(langid.BUCKETS, int)
    for r in langid.count_trigrams(df).collect():
        got[r.bucket] += r.n
    assert (got == np.bincount(langid.trigrams([t.encode() for t in texts])[0], minlength=langid.BUCKETS)).all()


def test_without_labels_nothing_is_known(spark):
    empty = langid.learn(spark.createDataFrame([], "lang string, text string"))
    (row,) = langid.predict(spark.createDataFrame([(1, EN)], "doc_id long, text string"), "text", empty).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_mixture_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    ll, doc = -rng.random((60, 3)) * 5, np.repeat([0, 1, 2], 20)
    begins = np.array([0, 20, 40])
    even = np.add.reduceat(np.log(np.exp(ll).mean(1)), begins)
    share, got = langid.mixture(ll, doc, begins, np.ones((3, 3)))
    assert np.allclose(share.sum(1), 1) and (got >= even - 1e-9).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op10_language_mixture(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
