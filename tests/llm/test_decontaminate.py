from cohortlens.llm import decontaminate as d

ITEM = "Yesterday the farmer Tom sold 12 sacks of wheat and then Tom carried 30 kg of barley home to the old mill."
OTHER = ITEM.replace("Tom", "Ann").replace("12", "7").replace("30 kg", "45 pounds")
MIXED = ITEM.replace("farmer Tom", "farmer Ann").replace("then Tom", "then Bob")
MERGED = ITEM.replace("12", "30")


def leaks(spark, docs, items=((1, ITEM),)):
    rows = [(k, t, "clash", 0) for k, t in docs]
    got = d.template_leaks(spark.createDataFrame(rows, "doc_id long, text string, item string, place int"), spark.createDataFrame(list(items), "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r for r in got}


def test_copies_and_changed_questions_are_found(spark):
    pad = "some words before that mean nothing at all here and there. "
    got = leaks(spark, [(1, pad + ITEM), (2, pad + OTHER + " " + pad), (3, pad + MIXED), (4, pad), (5, MERGED), (6, ITEM[:45]), (7, None), (8, ""), (None, ITEM), (9, ITEM), (9, ITEM), (10, (pad + "\n") * 2000 + ITEM)])
    assert {k for k, _ in got} == {1, 2, 9, 10}
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed == 4
    assert got[1, 1].n_windows == got[2, 1].n_windows > 10


def test_passages_and_short_or_slotted_items(spark):
    half = " ".join(ITEM.split()[6:18])
    items = [(1, ITEM), (2, "Too short to count."), (3, None), (4, "1 2 3 4 5 6 7 8 9 10"), (None, ITEM)]
    got = leaks(spark, [(1, half), (2, "Too short to count."), (3, "9 8 7 6 5 4 3 2 1 0")], items)
    assert set(got) == {(1, 1)}
    assert leaks(spark, [], items) == {} and leaks(spark, [(1, ITEM)], []) == {}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = [(1, ITEM), (2, OTHER), (3, MIXED)]
    before = leaks(spark, docs)
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    assert leaks(spark, docs) == before


def test_no_python_in_the_plan(spark):
    plan = d.op9_template_decontamination(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
