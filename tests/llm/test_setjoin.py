"""The Jaccard join against all pairs."""

import random

import pytest

from cohortlens.llm import setjoin


def plain(docs, width, similarity):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for doc_id, text in docs:
        words = [w for w in (text or "").translate(low).replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets[doc_id] = {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def run(spark, docs, **args):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, comp string, n_shingles int")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.similar(df, "doc_id", "text", **args).collect()}


def edited(r, words, share, vocabulary):
    out = []
    for w in words:
        x = r.random()
        out += [r.choice(vocabulary)] if x < share / 2 else [] if x < 0.7 * share else [w, r.choice(vocabulary)] if x < share else [w]
    return " ".join(out)


@pytest.mark.parametrize("seed, width, similarity, few", [(1, 4, 85, False), (2, 1, 80, True), (4, 3, 60, False)])
def test_all_pairs(spark, seed, width, similarity, few):
    """Families of near copies without their base, copies of copies, shared passages, short texts, repeats."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25 if few else 400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    docs = []
    for _ in range(6):
        base = [r.choice(vocabulary) for _ in range(r.choice([20, 60, 150]))]
        for share in [0.005, 0.01, 0.02, 0.03, 0.05, 0.08] * 6:
            text = edited(r, base, share, vocabulary)
            docs.append(text if r.random() < 0.7 else edited(r, text.split(), share, vocabulary))
    docs += [passage + " " + " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 5, 30, 100]))) for _ in range(60)]
    docs += [" ".join(r.choice(vocabulary[:4]) for _ in range(r.randint(1, 5))) for _ in range(60)]
    docs += docs[:20] + ["", " \t\n", None, "Only\x0bone", "only one", "ONLY ONE", "x" * 50_000, passage.upper()]
    r.shuffle(docs)
    rows = list(enumerate(docs))
    assert run(spark, rows, width=width, similarity=similarity) == {**plain([(i, t.replace("\x0b", " ") if t else t) for i, t in rows], width, similarity)}


def test_large_group(spark):
    """One family of near copies, many of them unlike each other: comparisons stay in proportion to its members."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [r.choice(vocabulary) for _ in range(120)]
    docs = [(i, edited(r, base, r.choice([0.01, 0.02, 0.04, 0.06]), vocabulary)) for i in range(500)]
    assert run(spark, docs) == plain(docs, 4, 85)


def test_odd_rows(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, None), (1, one), (2, one), (None, one), (None, None), (3, two), (3, two), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in setjoin.similar(df, "doc_id", "text").collect()], key=str)
    assert got == sorted([(1, 37, 1), (2, 37, 1), (3, 37, 3), (4, 0, 4), (None, 37, None), (None, 0, None)], key=str)
    assert setjoin.similar(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
