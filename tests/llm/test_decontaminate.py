import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm.decontaminate import _marks, aligned, contaminated, grams, normalised, windows_of

R = random.Random(4)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 8))) for _ in range(3000)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def distances(pattern, text):
    """Least edits of the pattern against any piece of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=9).map(str.encode), st.text(alphabet="ab", max_size=14).map(str.encode), st.integers(0, 4))
def test_alignment_against_the_whole_table(pattern, text, most):
    got = aligned(pattern, text, -len(pattern), len(text), most)
    want = distances(pattern, text)
    assert (got is None) == (want > most)
    if got:
        assert got[0] == want and distances(pattern, text[got[1] : got[2]]) == want


def norm(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return normalised(raw, np.array([0, len(raw)]))[0].tobytes()


def edited(text, k):
    out = list(text)
    for _ in range(k):
        i = R.randrange(len(out))
        out[i] = R.choice(["", "q", out[i] + "z"])
    return "".join(out)


def test_against_brute_force(spark):
    items = [(i, prose(R.choice([4, 20, 60]))) for i in range(6)] + [(6, ""), (7, None), (8, "abc"), (9, prose(15)), (None, prose(18))]
    items.append((10, items[9][1]))
    docs = []
    for d in range(60):
        parts = [prose(R.randrange(40))]
        if d % 3 == 0:
            parts.append(edited(R.choice([t for i, t in items[:6]]), R.choice([0, 1, 3, 8, 25])).upper())
        docs.append((d, "\n".join([*parts, prose(R.randrange(40))])))
    docs += [(100, None), (101, ""), (None, items[1][1]), (102, items[9][1]), (102, items[9][1]), (103, items[10][1]), (104, prose(30000) + " " + items[2][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'e' AS edits", "1 AS item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    rows = contaminated(frame, bench).collect()
    got = sorted((str(r.doc_id), str(r.item_id), r.n_windows) for r in rows)
    want = []
    for d, t in docs:
        if d == 104:
            want.append((str(d), "2", len(windows_of(2, items[2][1]))))
            continue
        for i, text in items:
            n = sum(distances(w.text, norm(t)) <= w.edits for w in windows_of(i, text))
            if n:
                want.append((str(d), str(i), n))
    assert got == sorted(want) and len(got) > 10
    whole = next(r for r in rows if r.doc_id == 102)
    assert (whole.char_start, whole.char_end, whole.edits) == (0, len(items[9][1]), 0)
    assert contaminated(frame.limit(0), bench).count() == 0 and contaminated(frame, bench.limit(0)).count() == 0


def test_passages_of_a_long_item_at_every_offset(spark):
    item = norm(prose(70)).decode()
    cuts = [(n, o) for n in (75, 80, 110, 130) for o in range(len(item) - n + 1)]
    docs = [(i, f"{prose(12)} {item[o : o + n]} {prose(12)}") for i, (n, o) in enumerate(cuts)]
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(cuts)))


def test_a_large_benchmark_gives_the_rows_of_a_small_one(spark):
    """Routed by q-grams to slices, in small groups: the same rows as in one broadcast pass."""
    items = [(i, prose(R.choice([3, 12, 40, 90]))) for i in range(60)] + [(100, "abc"), (101, "Yes!"), (None, prose(20)), (102, None), (103, "aaaaaaaaaaaaaaaaaaaaaaaa" * 5)]
    items.append((104, items[5][1]))
    docs = [(d, " ".join([prose(20), edited(R.choice(items[:60])[1], R.choice([0, 0, 2, 6])), prose(20)])) for d in range(80)]
    docs += [(200, " ABC. "), (201, "yes"), (202, "the abc"), (203, None), (204, ""), (None, items[62][1]), (205, items[5][1]), (205, items[5][1]), (206, "a" * 500), (207, prose(20000) + items[7][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'e' AS edits", "1 AS k0_", "2 AS slice").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **o: sorted((str(tuple(r)) for r in contaminated(frame, bench, **o).collect()))
    one = rows()
    assert rows(slice_bytes=2000, group_bytes=20_000) == one and len(one) > 60
    short = sorted((r.doc_id, r.item_id, r.char_start, r.char_end) for r in contaminated(frame, bench).collect() if r.item_id in (100, 101))
    assert short == [(200, 100, 1, 4), (201, 101, 0, 3)]
    assert contaminated(frame.limit(0), bench, slice_bytes=2000).count() == 0


def test_windows_are_sought_without_their_commonest_grams():
    """Half of what a match must share may be left out: the keys that stay, and the bound, still hold for every text within the edits."""
    text = "in the middle of the night of the long journey of the seven ships and the crew of the last one of them all"
    windows = windows_of(1, text)
    common = np.unique(np.concatenate([grams(np.frombuffer(b" of the ", np.uint8)), grams(np.frombuffer(text[20:60].encode(), np.uint8))]))
    every, least = _marks(1, text, 0.08, np.zeros(0, np.uint64))
    some, fewer = _marks(1, text, 0.08, common)
    assert set(some.tolist()) < set(every.tolist()) and grams(np.frombuffer(b" of the ", np.uint8))[0] not in some and 1 <= fewer < least
    pick = random.Random(1)
    for _ in range(200):
        w = pick.choice(windows)
        own = list(w.text)
        for _ in range(w.edits):
            own[pick.randrange(len(own))] = ord("z")
        assert len(np.intersect1d(grams(np.array(own, np.uint8)), some)) >= fewer


def test_ids_of_any_type(spark):
    """Text ids, null among them, in one slice and in many."""
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    docs = spark.createDataFrame([("d1", f"see {text} now"), ("d2", "nothing at all here"), (None, text)], "doc_id string, text string")
    items = spark.createDataFrame([("i1", text), (None, text), ("i2", "other words " * 12)], "item_id string, text string")
    want = sorted((d, i) for d in ("d1", "None") for i in ("i1", "None"))
    for slice_bytes in (1 << 20, 90):
        assert sorted((str(r.doc_id), str(r.item_id)) for r in contaminated(docs, items, slice_bytes=slice_bytes).collect()) == want
