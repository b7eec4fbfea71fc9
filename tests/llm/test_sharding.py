import zlib

import pytest

from siltstone.llm.sharding import SlotMap, sharded, slot_bytes, slotted

ODD = [(1, "ab"), (2, None), (2, None), (None, "é"), (3, ""), (3, ""), (4, "x" * 5000)] + [(i, "same text") for i in range(5, 300)]


def test_places_sizes_and_balance(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'x' AS size", "1 AS shard", "2 AS slot")
    rows = sharded(docs, n_shards=4).collect()
    assert len(rows) == len(ODD)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == want
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    small = spark.createDataFrame([(i, "t" * (i % 50)) for i in range(4000)], "doc_id long, text string")
    load = {}
    for r in sharded(small, n_shards=4).collect():
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert max(load.values()) - min(load.values()) <= 51


def test_empty(spark):
    assert sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_map_edits_and_versions(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * (i % 97)) for i in range(2000)], "doc_id long, text string")
    weights = slot_bytes(slotted(docs, 256), 256)
    assert sum(weights) == sum(i % 97 + 1 for i in range(2000))
    one = SlotMap.balanced(weights, 4)
    two = one.grown(weights)
    moved = [b for a, b in zip(one.shards, two.shards) if a != b]
    assert moved and set(moved) == {4} and two.version == 2
    heavier = [w * (3 if s == 0 else 1) for w, s in zip(weights, one.shards)]
    three = one.rebalanced(heavier)
    load = three._loads(heavier, 4)
    assert max(load) - min(load) <= max(0.01 * sum(load) / 4, max(heavier))
    for m in (one, two):
        m.save(spark, str(tmp_path / "map"))
    assert SlotMap.load(spark, str(tmp_path / "map")) == two
    assert SlotMap.load(spark, str(tmp_path / "map"), 1) == one
    with pytest.raises(ValueError):
        SlotMap.load(spark, str(tmp_path / "map"), 9)
    two.save(spark, str(tmp_path / "map"))
    assert SlotMap.load(spark, str(tmp_path / "map")) == two


def loads(rows):
    out = {}
    for r in rows:
        out[r.shard] = out.get(r.shard, 0) + r.size
    return out


def test_hot_rows_spread(spark):
    """Equal rows, rows of one id and rows without id: shards differ by one record at most, and places are gapless."""
    odd = [(None, "")] * 20_000 + [(7, "same")] * 20_000 + [(8, f"text {i}") for i in range(5000)] + [(i, "x" * (i % 60)) for i in range(5000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").repartition(9)
    rows = sharded(docs).collect()
    assert len(rows) == len(odd)
    load = loads(rows)
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 61
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    again = sharded(docs.repartition(2)).collect()
    key = lambda rows: sorted((str(r.doc_id), r.text_crc32, r.virtual_slot, r.shard, r.slot) for r in rows)
    assert key(again) == key(rows)


def test_a_stored_map_is_edited(spark, tmp_path):
    path = str(tmp_path / "slots")
    docs = spark.createDataFrame([(i, "t" * (i % 97)) for i in range(4000)], "doc_id long, text string")
    first = {r.doc_id: r.shard for r in sharded(docs, 4, 256, path).collect()}
    same = sharded(docs, 4, 256, path).collect()
    assert {r.map_version for r in same} == {1} and {r.doc_id: r.shard for r in same} == first
    heavy = docs.selectExpr("doc_id", "if(doc_id % 7 = 0, repeat('x', 900), text) AS text")
    assert {r.map_version for r in sharded(heavy, 4, 256, path).collect()} == {2}
    grown = sharded(docs, 5, 256, path).collect()
    assert {r.map_version for r in grown} == {3} and set(loads(grown)) == set(range(5))
