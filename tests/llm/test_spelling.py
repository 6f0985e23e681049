"""The trie frontier against all pairs, and the counts against a plain loop."""

import random
import re
import zlib
from collections import Counter

import pytest

from cohortlens.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def plain_counts(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def plain(counts):
    form, rows = {}, []
    of = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, vs in of.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, counts[w], len(of[w]), counts[form[w]] if w in form else None))
    return sorted(rows, key=str)


def result(df):
    return sorted([(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()], key=str)


@pytest.mark.parametrize("letters, sizes, n", [("ab", (4, 9), 150), ("abcdeÿ×", (5, 7), 250), ("aé", (5, 12), 120)])
def test_all_pairs(spark, letters, sizes, n):
    r = random.Random(n)
    words = {"".join(r.choice(letters) for _ in range(r.randint(*sizes))) for _ in range(n)}
    counts = {w: r.choice([3, 3, 6, 7, 13, 30, 100]) for w in sorted(words)}
    assert result(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain(counts)


def test_long_words_and_shared_halves(spark):
    r = random.Random(5)
    base = "".join(r.choice("abc") for _ in range(3000))
    words = [base, base[:10] + "x" + base[11:], base + "a", base[1:], base[:2990], base[:1500] + "y" + base[1500:], "aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aaaaab"]
    counts = {w: 3 * 2 ** i for i, w in enumerate(words)}
    assert result(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain(counts)


def test_counts_of_documents(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdeÉéZ") for _ in range(r.randint(3, 8))) for _ in range(30)]
    docs = [(i % 400 if i % 7 else None, " ".join(r.choice(base) + r.choice(["", "-", "1", "!"]) for _ in range(20))) for i in range(500)]
    docs += [(1, None), (2, ""), (3, "a" * 5000), (3, "a" * 5000), (3, "a" * 5000), (4, "\U0001F600 中文 12")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n long")
    counts = spelling.word_counts(df, "doc_id", "text")
    assert {x.word: x.n for x in counts.collect()} == plain_counts(docs)
    assert result(spelling.variants(counts)) == plain(plain_counts(docs))


def test_empty(spark):
    assert result(spelling.variants(spelling.word_counts(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text"))) == []


def test_nothing_that_grows_with_the_vocabulary_is_broadcast(spark, monkeypatch):
    """Sizes are guessed before rows are exploded, so tables of any size passed for small and were collected on the driver."""
    plans = []
    settle = spelling.settle
    monkeypatch.setattr(spelling, "settle", lambda df: plans.append(df) or settle(df))
    words = ["planet", "planets", "planett", "plane", "plabet", "orbit", "orbits", "orbits1"]
    out = spelling.variants(spark.createDataFrame([(w, 3 * 2 ** i) for i, w in enumerate(words)], "word string, n long"))
    for df in [*plans, out]:
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(spelling.op12_spelling_variants(spark, sf)) == plain(plain_counts(docs))
