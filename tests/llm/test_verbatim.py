import pytest

from cohortlens.llm import decontaminate as d

ITEMS = [(1, "Too short to count."), (2, "12 + 30 - 7 = 35"), (3, "1 2 3 4 5 6 7 8 9 10"), (4, "He met Ann Bea Cid Dan Eve Fay Gus Hal Ida."),
         (5, "今天天气很好吗"), (6, "WHICH OF THESE RIVERS IS THE LONGEST IN EUROPE"), (9, "What is the tallest tree in the forest?"), (7, None), (8, "?!"), (None, "Nobody asks this.")]
PAD = "some words before, that mean nothing "


def pairs(spark, docs, items=ITEMS):
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    return {(r.doc_id, r.item_id) for r in got}


def test_a_copy_of_every_item_is_found(spark):
    docs = [(i, PAD + t + " and after") for i, t in ITEMS if t and i and i != 8] + [(11, "他问今天天气很好吗他走了"), (12, "too  short\nto count")]
    assert pairs(spark, docs) == {(i, i) for i in (1, 2, 3, 4, 5, 6, 9)} | {(11, 5), (12, 1)}


def test_other_values_are_no_copy(spark):
    docs = [(1, PAD + "Too long to count."), (2, PAD + "12 + 30 + 7 = 49"), (3, "9 8 7 6 5 4 3 2 1 0"), (4, "He met Abe Ben Cora Dot Eli Flo Gil Hans Ian."),
            (5, "今天天气不好吗"), (6, "WHICH OF THOSE LAKES IS THE DEEPEST IN ASIA"), (7, None), (8, ""), (None, "Too short to count.")]
    assert pairs(spark, docs) == set()
    assert pairs(spark, [], ITEMS) == set() == pairs(spark, [(1, PAD)], [])


@pytest.mark.parametrize("rows", [0, d.BROADCAST_ROWS])
def test_template_finds_come_once_beside_verbatim_ones(spark, monkeypatch, rows):
    monkeypatch.setattr(d, "BROADCAST_ROWS", rows)
    long = "Yesterday the farmer sold his sacks of wheat and then carried the barley home to the old mill."
    assert pairs(spark, [(1, long + " Too short to count."), (2, PAD)], [(1, long), (2, ITEMS[0][1]), (2, "Another short row.")]) == {(1, 1), (1, 2)}
