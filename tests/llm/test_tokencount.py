import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a<|endoftext|>b <|endoftext|>", "it's  123 …\n\n", "日本語 🙂", "x" * 3000, "the cat " * 400, "the cat " * 400, "\x00\x85  \t"]


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("frequent, tracked, cached", [(1 << 16, 1 << 20, 1 << 20), (2, 4, 3), (0, 1, 1)])
def test_counts_are_the_librarys(spark, monkeypatch, frequent, tracked, cached):
    """The size of either tier never changes a count."""
    monkeypatch.setattr(tokencount, "TRACKED", tracked)
    monkeypatch.setattr(tokencount, "CACHED", cached)
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "clash", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, __n long")
    got = tokencount.count_tokens(df, "text", PATH, frequent=frequent).collect()
    count = library()
    assert len(got) == len(rows)
    for r in got:
        n = count(TEXTS[r.doc_id])
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 1024, len((TEXTS[r.doc_id] or "").encode()))
        assert r.text == TEXTS[r.doc_id]


def test_empty_table_and_refused_files(spark):
    assert tokencount.count_tokens(spark.createDataFrame([], "doc_id long, text string"), "text", PATH).count() == 0
    with pytest.raises(ValueError):
        tokencount.count_tokens(spark.createDataFrame([], "doc_id long, text string"), "text", public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark):
    count = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = tokencount.op7_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts) and all(r.n_tokens == count(texts[r.doc_id]) for r in got)
