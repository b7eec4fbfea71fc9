"""Repeated passages against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import suffixes
from siltstone.llm.suffixes import anchored, bucket_repeats, deduplicated, merged, multikey_quicksort


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = merged([(i, i + length) for i in range(len(d) - length + 1) if seen[d[i : i + length]] > 1])
        kept = b"".join(d[s:e] for s, e in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(d)]))
        out.append((len(d), len(d) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    """Passages at other places, in other surroundings, cut at both ends, twice in one text, and whole copies."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdé") for _ in range(pick.randint(1, 5)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(pick.randint(5, 60)) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [text(pick.randint(0, 20))]
        for _ in range(pick.randint(0, 3)):
            own = pick.choice(shared)
            a, b = sorted((pick.randint(0, len(own)), pick.randint(0, len(own))))
            parts += [own[a:b] if pick.random() < 0.6 else own, text(pick.randint(0, 6))]
        out.append(pick.choice(["", " "]).join(parts))
    return out + out[:7] + out[:2] * 3 + [None, "", "x", "é" * 300, "ab" * 200, "ab" * 150]


def result(spark, texts, length):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    return [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in deduplicated(docs, length).orderBy("doc_id").collect()]


@pytest.mark.parametrize("length, seed", [(12, 1), (40, 2)])
def test_against_all_windows(spark, length, seed):
    texts = corpus(seed)
    assert result(spark, texts, length) == brute(texts, length)


def test_blocks_of_one_gram_in_many_buckets(spark, monkeypatch):
    """One passage in many surroundings: its blocks lie on both sides of the splitters; and long texts go in segments."""
    monkeypatch.setattr(suffixes, "BUCKET_BLOCKS", 7)
    monkeypatch.setattr(suffixes, "SEGMENT", 50)
    pick = random.Random(3)
    passage = "".join(pick.choice("abcdefgh") for _ in range(70))
    texts = ["".join(pick.choice("xyz") for _ in range(pick.randint(0, 30))) + passage[pick.randint(0, 20) : pick.randint(50, 70)] + "".join(pick.choice("xyz") for _ in range(pick.randint(0, 30))) for _ in range(120)]
    assert result(spark, texts, 32) == brute(texts, 32)
    assert result(spark, ["".join(texts)], 32) == brute(["".join(texts)], 32)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a" * 50, "k", 5), (None, "a" * 50, "k", None)], "key_a int, text string, kept string, gram int")
    rows = deduplicated(docs, 20).orderBy("gram").collect()
    assert [(r.key_a, r.gram, r.n_removed, r.kept) for r in rows] == [(None, None, 50, b""), (1, 5, 50, b"")]
    assert deduplicated(docs.limit(0), 20).count() == 0


def test_equal_windows_have_equal_anchors():
    data = np.frombuffer(bytes(random.Random(4).choices(b"abc", k=3000)), np.uint8)
    doc, lo, anchor, n, gram, block = anchored(data, np.array([0, 1000, 3000]), 20)
    assert sorted(w for a, k in zip(lo, n) for w in range(a, a + k)) == [*range(981), *range(1000, 2981)]
    assert (lo + n - 1 <= anchor).all() and (anchor + suffixes.gram_length(20) <= lo + 20).all()
    place = {}
    for a, p, k in zip(lo, anchor, n):
        for w in range(a, a + k):
            assert place.setdefault(data[w : w + 20].tobytes(), p - w) == p - w


def test_multikey_quicksort():
    rows = np.random.default_rng(5).integers(0, 3, (500, 6)).astype(np.uint64)
    order = multikey_quicksort(rows)
    assert sorted(order) == list(range(500))
    assert [tuple(rows[i]) for i in order] == sorted(map(tuple, rows))


def test_windows_that_neither_neighbour_shows():
    """Each window of the first block is found in another block: the nearest ones on the right and on the left share too little on the other side."""
    middle, width = "GGGGGG", 10
    blocks = [("lmnop", "qrstu"), ("XXnop", "qrYYY"), ("ZZZZp", "qrstu"), ("lmnop", "VVVVV"), ("XXXop", "qrsZZ")]
    left, right = (pa.array(side, pa.binary()) for side in zip(*((a[::-1].encode(), (middle + b).encode()) for a, b in blocks)))
    whole, windows = [(a + middle + b).encode() for a, b in blocks], 16 - width + 1
    repeats, edge, _ = bucket_repeats(np.full(5, 9), np.full(5, 5), np.full(5, windows), np.full(5, 1), right, left, width)
    assert edge[2].any() and edge[:, 0].all()
    seen = Counter((i, w[i : i + width]) for w in whole for i in range(windows))
    around = [i for i in range(windows) if i <= 5 and i + width >= 11]
    assert all(repeats[b, i] == (seen[i, whole[b][i : i + width]] > 1) for b in range(5) for i in around)


def test_passages_of_over_fifty_words_at_the_contract_length(spark, tmp_path):
    """The query's own 400 bytes: one byte less is kept however many words it has, also where only a space differs; n_removed tells them apart, n_bytes is the text's size."""
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(6))
    rest = lambda k: " ".join(word() for _ in range(k))
    exact, short, spaced = (rest(58)[:n] for n in (400, 399, 400))
    assert all(len(p.split()) > 50 for p in (exact, short, spaced))
    texts = [f"{rest(80)} {a}{p}{b} {rest(90)}" for p, q in ((exact, exact), (short, short), (spaced, spaced.replace(" ", "\n", 30))) for a, p, b in (("X", p, "Y"), ("V", q, "W"))] + [rest(200), "é" * 199]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in suffixes.query(spark, str(tmp_path)).collect()}
    assert [rows[i].n_removed for i in range(len(texts))] == [400, 400, 0, 0, 0, 0, 0, 0]
    assert [tuple(rows[i])[1:] for i in range(len(texts))] == brute(texts, 400)


def test_zero_bytes_at_the_ends_of_blocks(spark):
    """A block that ends where others go on with bytes of 0 stands before these in order, not among them; and so to the left."""
    middle, width = "GGGGGGxyz", 10
    for blocks in ([("a", middle + "\0"), ("b", middle), ("c", middle + "\0")], [("\0xyz", "GGGGGGa"), ("xyz", "GGGGGGb"), ("\0xyz", "GGGGGGc")]):
        left, right = (pa.array(side, pa.binary()) for side in zip(*((a[::-1].encode(), b.encode()) for a, b in blocks)))
        off, n = (np.array(x) for x in zip(*((len(a), len(a + b) - width + 1) for a, b in blocks)))
        repeats, _, _ = bucket_repeats(np.full(3, 9), off, n, np.full(3, 1), right, left, width)
        seen = Counter((off[b] - i, (blocks[b][0] + blocks[b][1])[i : i + width]) for b in range(3) for i in range(n[b]))
        assert seen.most_common(1)[0][1] == 2
        assert all(repeats[b, i] == (seen[off[b] - i, (blocks[b][0] + blocks[b][1])[i : i + width]] > 1) for b in range(3) for i in range(n[b]))
    pick = random.Random(1008)
    text = lambda n: "".join(pick.choice("\0a") for _ in range(n))
    pool = [text(pick.randint(4, 32)) for _ in range(8)]
    texts = [text(pick.randint(0, 6)) + pick.choice(pool)[pick.randint(0, 4) :] + pick.choice(["", "\0\0"]) for _ in range(60)]
    assert result(spark, texts, 8) == brute(texts, 8)
