import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import lm

SCHEMA = "doc_id long, text string, part int, n_tokens string"


def words(text):
    return (text or "").encode().lower().split() + [b"<end>"]


def test_scores_match_plain_counts(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.6, 30) % 40) for _ in range(60)] + [None, "", "End START end\x00 \x0bé", "w1 " * 300]
    parts = [i % 3 for i in range(len(texts))]
    rows = [(i, t, p, "x") for i, (t, p) in enumerate(zip(texts, parts))] + [(1, texts[1], 1, "x")]
    got = lm.score_texts(spark.createDataFrame(rows, SCHEMA).repartition(5), "text", "part").collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "part", "n_tokens", "n_known", "train_tokens", "base_score", "score"}

    learn = [words(t) for _, t, p, _ in rows if p]
    uni, bi = Counter(w for d in learn for w in d), Counter(b for d in learn for b in zip([b"<s>"] + d, d))
    context = Counter(a for d in learn for a in [b"<s>"] + d[:-1])
    n, v = sum(uni.values()), len(uni)
    # weights from the left-out part by exact expectation-maximisation over tokens
    kept, left = [words(t) for _, t, p, _ in rows if p == 1], [words(t) for _, t, p, _ in rows if p == 2]
    u1, b1 = Counter(w for d in kept for w in d), Counter(b for d in kept for b in zip([b"<s>"] + d, d))
    c1, n1 = Counter(a for d in kept for a in [b"<s>"] + d[:-1]), sum(Counter(w for d in kept for w in d).values())
    bucket = lambda c: math.ceil(math.log2(c + 1))
    cells = {}
    for d in left:
        for a, w in zip([b"<s>"] + d, d):
            cells.setdefault(bucket(c1[a]), []).append((1 / (v + 1), u1[w] / n1, b1[a, w] / c1[a] if c1[a] else 0.0))
    grid = lambda f: np.where(f > 0, np.exp2(np.rint(lm.GRID * np.log2(np.maximum(f, 1e-300) * (v + 1))) / lm.GRID), 0)
    lam, last = {}, np.full(3, 1 / 3)
    for b in range(lm.BUCKETS):
        if b in cells:
            f, w = grid(np.array(cells[b])), np.full(3, 1 / 3)
            for _ in range(50):
                g = f * w
                w = (g / g.sum(1)[:, None]).mean(0)
            last = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
        lam[b] = last
    for r in got:
        d = words(r.text)
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in d)
        score = sum(math.log10(lam[bucket(context[a])] @ [1 / (v + 1), uni[w] / n, bi[a, w] / context[a] if context[a] else 0.0])
                    for a, w in zip([b"<s>"] + d, d))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(d), sum(uni[w] > 0 for w in d), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9)


def test_estimates_sum_to_one(spark):
    """The mixture over all known words and one unknown is a distribution for every seen context."""
    f, bucket = lm.estimates([np.array([2., 3, 1]), np.array([2., 2, 1])], 6.0, 4)
    assert f[1].tolist() == [0.2, 0.5, 1.0] and bucket.tolist() == [0, 2, 2]


def test_empty_and_unlearned(spark):
    assert lm.score_texts(spark.createDataFrame([], SCHEMA), "text", "part").count() == 0
    (row,) = lm.score_texts(spark.createDataFrame([(None, "a b", 0, "x")], SCHEMA), "text", "part").collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and math.isfinite(row.score)


def test_query_beats_its_base_on_held_out_texts(spark):
    rows = lm.op5_interpolated_lm(spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
