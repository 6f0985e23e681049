import numpy as np
import pytest

from cohortlens.llm import neardup
from cohortlens.llm.components import components


def sets(texts, width):
    out = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        out[k] = frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def plain(texts, width):
    have, up = sets(texts, width), {k: k for k in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    keys = sorted(k for k in texts if have[k])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(have[a] & have[b])
            if 100 * both >= 80 * (len(have[a]) + len(have[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(have[k]), root(k)) for k in texts}


def corpus():
    rng = np.random.default_rng(5)
    texts = {}
    for family in range(12):
        words = [f"f{family}w{int(x)}" for x in rng.integers(0, 400, rng.integers(3, 120))]
        for copy in range(10):
            mine = list(words)
            for i in rng.integers(0, len(words), rng.integers(0, 1 + len(words) // 12)):
                mine[i] = f"new{copy}{i}"
            texts[len(texts) + 10] = " ".join(mine)
    texts |= {0: None, 1: "", 2: " \n", 3: "One", 4: "one", 5: "ONE two", 6: "É x", 7: "é x", 8: "z " * 4000, 9: "z " * 4001}
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_all_pairs(spark, width):
    texts = corpus()
    rows = [(k, t, "clash", "x") for k, t in texts.items()]
    rows += [rows[3], rows[-1], (None, "one", "clash", "x"), (None, "one", "clash", "x")]
    got = neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string, id string, signature string").repartition(3), "doc_id", "text", width).collect()
    assert len(got) == len(texts) + 2
    want = plain(texts, width)
    for r in got:
        if r.doc_id is None:
            assert (r.n_shingles, r.component_id, r.kept) == (1, None, True)
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_a_group_around_the_threshold_loses_no_link(spark):
    """Copies with few to many edits, some shortened, some sharing an edit: much is linked, much is not."""
    rng = np.random.default_rng(9)
    base = [f"w{int(x)}" for x in rng.integers(0, 5000, 120)]
    texts = {0: " ".join(base)}
    for copy in range(1, 160):
        mine, rate = list(base), rng.uniform(0.01, 0.16)
        for i in np.flatnonzero(rng.random(len(mine)) < rate):
            mine[i] = f"e{int(i)}" if copy % 4 == 0 else f"n{copy}x{int(i)}"
        if copy % 5 == 0:
            del mine[:int(rng.integers(5, 40))]
        texts[copy] = " ".join(mine)
    got = neardup.cluster(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), "doc_id", "text", 2).collect()
    want = plain(texts, 2)
    assert {r.doc_id: r.component_id for r in got} == {k: c for k, (_, c) in want.items()}
    assert 5 < len({c for _, c in want.values()}) < 150


def test_empty_table(spark):
    assert neardup.cluster(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_every_pair_under_the_distance_shares_a_key():
    """The pigeonhole guarantee, for the largest distance and the worst spread of differences."""
    import pyarrow as pa
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, neardup.CHUNKS * neardup.LENGTH).astype("<u2")

    def keys(s):
        batch = pa.RecordBatch.from_arrays([pa.array([s.tobytes()]), pa.array([1])], names=["signature", "id"])
        return set(next(neardup.chunk_keys(iter([batch]))).column("key").to_pylist())
    for trial in range(300):
        other = base.copy()
        if trial:
            at = rng.choice(len(base), neardup.DISTANCE, replace=False)
        else:  # two in every chunk but one
            at = np.array([c * neardup.LENGTH + i for c in range(neardup.CHUNKS) for i in (0, 1)])[:neardup.DISTANCE]
        other[at] ^= 1 + rng.integers(0, 1000, len(at)).astype("<u2")
        assert keys(base) & keys(other)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    factors = neardup.multipliers(neardup.CHUNKS * neardup.LENGTH)
    agree = []
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        one, two = (np.frombuffer(neardup.signature(np.unique(x), factors), "<u2") for x in (pool[:160], pool[20:]))
        agree.append((one == two).mean())
    assert abs(np.mean(agree) - 140 / 180) < 0.01


def test_a_full_filter_only_passes_more(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FILTER_BITS", 64)
    texts = {k: t for k, t in corpus().items() if k < 60}
    got = neardup.cluster(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text", 2).collect()
    want = plain(texts, 2)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_links_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(140, 139), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 141)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_repeated_id_with_a_missing_text(spark):
    """A null or empty row of an id does not hide its text."""
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(1, None), (1, text), (1, ""), (2, text), (3, None), (3, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {1: (36, 1, True), 2: (36, 1, False), 3: (0, 3, True)}


def passage_members(spark, n, seed=4):
    """Signatures of texts that share a passage and differ in the rest, some of them near others, as members of one open bucket."""
    rng = np.random.default_rng(seed)
    passage = rng.integers(0, 1 << 16, 80)
    rows = []
    for k in range(n):
        own = rng.random(80) > rng.choice([0.3, 0.45])
        s = np.where(own, rng.integers(0, 12, 80) if k % 2 else rng.integers(0, 1 << 16, 80), passage)
        if k and k % 5 == 0:  # near the one before, around the distance
            s = np.array(rows[-1])
            at = rng.choice(80, rng.integers(20, 40), replace=False)
            s[at] = rng.integers(0, 1 << 16, len(at))
        rows.append([int(v) for v in s])
    kept = [(k + 1, np.array(s).astype("<u2").tobytes(), 100) for k, s in enumerate(rows)]
    classes = spark.createDataFrame(kept, "id long, signature binary, n_shingles long")
    open_ = spark.createDataFrame([(1, 0, k + 1, k + 1) for k in range(n)], "key long, first long, id long, c long")
    return np.array(rows), classes, open_, spark.createDataFrame([], "a long, b long")


def test_token_join_loses_no_near_pair_and_forms_few_others(spark):
    """Pairs that share a rare value, but have too many rarer ones that differ, were formed once for each shared value."""
    rows, classes, open_, stars = passage_members(spark, 300)
    got = {(r.a - 1, r.b - 1) for r in neardup.inside(open_, stars, classes, 80).collect()}
    differ = (rows[:, None] != rows[None]).sum(2)
    near = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if differ[i, j] <= neardup.DISTANCE}
    assert len(near) > 30 and near <= got
    values = {}
    for p in range(80):
        for v, c in zip(*np.unique(rows[:, p], return_counts=True)):
            values[p, int(v)] = c
    first = [set(sorted(((p, int(v)) for p, v in enumerate(s)), key=lambda t: (values[t], t))[:neardup.DISTANCE + 1]) for s in rows]
    before = sum(bool(first[i] & first[j]) for i in range(len(rows)) for j in range(i))
    assert 4 * len(got) < 3 * before
