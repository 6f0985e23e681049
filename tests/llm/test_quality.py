import itertools
import math
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import quality

TEXTS = [None, "", " \n\t", "one", "a b c d e f g h i " * 30, "Line one is here.\nLine one is here.\n\n \nLine one is here. \nx | y | z | w |\x0b\x0c", "#$% <a>|&* 　é",
         "w " * 19 + "end", "w1 w2 w3 w4 w5 w6 w7 w8 z " + " ".join(f"v{i}" for i in range(40)) + " w1 w2 w3 w4 w5 w6 w7 w8", "same\n" * 3000]


def plain(text):
    text = text or ""
    words = [w for w in text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures_match_plain_ones(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] * 2
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int"), "text", quality.PRIOR).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and r.content_share >= 0.5)
    assert quality.judge(spark.createDataFrame([], "text string"), "text", quality.PRIOR).count() == 0


def test_measures_do_not_depend_on_batches(monkeypatch):
    whole = list(quality.measured([t or "" for t in TEXTS], quality.PRIOR))
    monkeypatch.setattr(quality, "CHUNK", 5)
    assert list(quality.measured([t or "" for t in TEXTS], quality.PRIOR)) == whole


def score(field, masks, labels):
    s = sum(field.emission(m) for m, y in zip(masks, labels) if y)
    return s + sum(field.step[a][b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_the_best_labelling(seed):
    rng = np.random.default_rng(seed)
    field = quality.Field(rng.normal(size=16).tolist(), rng.normal(size=(2, 2)).tolist())
    masks = rng.integers(0, 1 << 16, 9).tolist()
    best = max(itertools.product((0, 1), repeat=9), key=lambda y: score(field, masks, y))
    assert quality.Field.viterbi(field, masks) == list(best)
    assert field.viterbi([]) == []


def test_fit_climbs_the_exact_likelihood():
    rng = np.random.default_rng(1)
    masks = [rng.integers(0, 8, rng.integers(1, 5)) for _ in range(40)]
    boiler = np.array([int(m.mean() > 3.5) for m in masks])

    def likelihood(field):
        total = 0.0
        for m, y in zip(masks, boiler):
            every = [score(field, m.tolist(), z) for z in itertools.product((0, 1), repeat=len(m))]
            total += score(field, m.tolist(), [y] * len(m)) - math.log(sum(map(math.exp, every)))
        return total
    fitted = quality.fit(masks, boiler, rounds=300, ridge=0.0)
    base = likelihood(fitted)
    assert base > likelihood(quality.PRIOR)
    for i in range(3):  # no single weight can be moved for a clearly better likelihood
        for step in (-0.3, 0.3):
            moved = quality.Field([w + step * (i == j) for j, w in enumerate(fitted.weights)], fitted.step)
            assert likelihood(moved) < base + 0.3


def test_training_needs_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is quality.PRIOR
    assert quality.train(docs, labels.limit(0)) is quality.PRIOR


def test_lines_of_the_report(spark):
    text = "Plain sentence of many words that goes on and on for long here.\n\na | b | c | d | e\n$$$ ### %%% &&& ***\n"
    got = quality.labelled_lines(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), "doc_id", "text", quality.PRIOR).orderBy("line_no").collect()
    assert [(r.line_no, r.boilerplate) for r in got] == [(0, False), (2, True), (3, True)] and got[1].line == "a | b | c | d | e"


def test_query_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op3_quality_lines(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert all(r.kept for r in got if r.quality == 1)
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(bad) <= 0.1 * len(bad)
