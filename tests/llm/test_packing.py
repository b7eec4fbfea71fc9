import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm.packing import packed, packing

CAPS = (8, 16, 40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_bins_hold_their_pieces(sizes):
    bins, offset, capacity = packed(np.array(sizes, dtype=np.int64), CAPS, 1)
    assert len(bins) == len(sizes) and set(capacity.tolist()) <= set(CAPS)
    for b in range(len(capacity)):
        own = sorted((int(offset[i]), sizes[i]) for i in range(len(sizes)) if bins[i] == b)
        assert own and [o for o, _ in own] == np.cumsum([0, *(s for _, s in own)])[:-1].tolist()
        used = sum(s for _, s in own)
        assert used <= capacity[b] and capacity[b] == min(c for c in CAPS if c >= used)


def test_best_fit_is_tight():
    sizes = np.random.default_rng(0).integers(1, 40, 3000)
    _, _, capacity = packed(sizes, CAPS, 1)
    assert sizes.sum() / capacity.sum() > 0.98


def test_every_token_is_packed_once(spark):
    texts = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x " * 100), (4, "w " * 39), (5, "w " * 40)] + [(i, "t " * (i % 37)) for i in range(10, 300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS piece", "3 AS bin")
    for group in (20_000, 50):
        rows = packing(docs, CAPS, 1, group).collect()
        total = Counter()
        for r in rows:
            total[r.doc_id] += r.n_tokens
        want = Counter()
        for i, t in texts:
            want[i] += len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
        assert total == want
        own = sorted((r.piece, r.token_start, r.n_tokens) for r in rows if r.doc_id is None)
        assert own == [(0, 0, 40), (1, 40, 40), (2, 80, 21)]
        bins = defaultdict(list)
        for r in rows:
            bins[r.bin_group, r.bin].append(r)
        for own in bins.values():
            assert sum(r.n_tokens for r in own) <= own[0].capacity and len({r.bin_offset for r in own}) == len(own)
    assert packing(docs.limit(0), CAPS).count() == 0


def plain(sizes, capacities, overhead):
    """Best fit by looking through all bins; equal rooms: the bin last filled."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    rooms, stamp, used, out, now = [], [], [], {}, 0
    for at, p in enumerate(order):
        size, now = sizes[p], now + 1
        rest = [sizes[q] for q in order[at + 1 :]]
        fits = [b for b in range(len(rooms)) if rooms[b] >= size]
        if fits:
            b = min(fits, key=lambda b: (rooms[b], -stamp[b]))
        else:
            def cost(c):
                room = c - size
                return (c + overhead) / (size + min(room, sum(rest), sum(s for s in sizes if s <= min(room, size))))

            b = len(rooms)
            rooms.append(min((c for c in capacities if c >= size), key=lambda c: (cost(c), c)))
            used.append(0)
            stamp.append(0)
        out[p] = (b, used[b])
        used[b] += size
        rooms[b] -= size
        stamp[b] = now
    return [out[i] for i in range(len(sizes))], [min(c for c in capacities if c >= u) for u in used]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=50))
def test_against_a_plain_packer(sizes):
    bins, offset, capacity = packed(np.array(sizes, dtype=np.int64), CAPS, 1)
    assert (list(zip(bins.tolist(), offset.tolist())), capacity.tolist()) == plain(sizes, CAPS, 1)


def test_equal_rows_spread_over_groups(spark):
    docs = spark.range(50_000).selectExpr("cast(1 AS long) AS doc_id", "'a b c' AS text").repartition(7)
    rows = packing(docs, group_pieces=1000)
    sizes = [r["count"] for r in rows.groupBy("bin_group").count().collect()]
    assert sum(sizes) == 50_000 and max(sizes) <= 2000
