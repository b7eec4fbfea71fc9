import math
from collections import Counter, defaultdict

import numpy as np

from siltstone.llm.langid import NORMAL, code_lengths, identified, learn, trained

TEXTS = {"en": [b"the cat and the hat", b"then the dog"], "de": ["der hund und die katze für".encode()], "fr": ["le chat où".encode(), b"x"]}


def brute(texts, order, text):
    """Bits of a text by dictionaries of context counts."""
    seen = defaultdict(Counter)
    for t in texts:
        t = bytes(NORMAL[np.frombuffer(t, np.uint8)])
        for i, c in enumerate(t):
            for k in range(order + 1):
                seen[k, (b"\0" * k + t[:i])[len(t[:i]) :] if k else b""][c] += 1
    t, bits = bytes(NORMAL[np.frombuffer(text, np.uint8)]), 0.0
    for i, c in enumerate(t):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
                break
            own = seen.get((k, (b"\0" * k + t[:i])[len(t[:i]) :] if k else b""))
            if own is None:
                continue
            n, d = sum(own.values()), len(own)
            if own[c]:
                bits += math.log2((n + d) / own[c])
                break
            bits += math.log2((n + d) / d)
    return bits


def test_code_lengths_are_exact():
    model = trained(TEXTS)
    texts = [b"the hat", "für die zebra".encode(), b"", b"q", b"THE 1984 hat\n", bytes(range(1, 256))]
    got = code_lengths(model, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.languages):
            assert math.isclose(got[i, j], brute(TEXTS[lang], 4, t), rel_tol=1e-9, abs_tol=1e-9), (t, lang)


def test_predictions_and_odd_texts(spark):
    words = {"en": "the of and with for this there", "fr": "le la où été avec pour être"}
    rows = [(i, " ".join(words[k].split()[(i + j) % 7] for j in range(30)), k) for i in range(60) for k in words]
    odd = [(900, None, "en"), (901, "", None), (902, "123 !?", "en"), (None, "the of and with this there", None), (903, "THE OF AND " * 40000, None), (904, "日本", "en"), (5, "the of and", "en"), (5, "the of and", "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "0.1 AS score", "1 AS r", "2 AS o")
    out = identified(docs, learn(docs), "lang").collect()
    assert len(out) == len(rows) + len(odd)
    right = [r.lang_pred == r.lang for r in out if r.doc_id is not None and r.doc_id < 60 and r.doc_id != 5]
    assert all(right) and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r.lang_pred for r in out if r.doc_id is None or r.doc_id >= 900}
    assert got == {900: "und", 901: "und", 902: "und", None: "en", 903: "en", 904: got[904]} and got[904] != "und"
    assert identified(docs.limit(0), learn(docs.limit(0))).count() == 0
    assert {r.lang_pred for r in identified(docs, learn(docs.limit(0))).collect()} == {"und"}


def test_any_number_of_languages(spark):
    """Languages in slices give the rows of one model of them all; texts longer than a piece are learned from too."""
    words = {f"l{k:02}": [f"{chr(97 + k)}{chr(97 + (k * j) % 26)}{chr(97 + j % 26)}" for j in range(12)] for k in range(23)}
    rows = [(i * 23 + k, " ".join(words[lang][(i * j) % 12] for j in range(25)), lang) for i in range(12) for k, lang in enumerate(words)]
    rows += [(9000 + k, " ".join(f"{lang}only " for _ in range(30000)), f"long{k}") for k, lang in enumerate(("xq", "zw"))] + [(9100, None, "en"), (9101, "", "en"), (None, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS bits_")
    whole, parts = learn(docs, slice_=100), learn(docs, slice_=4)
    assert len(whole) == 1 and len(parts) > 5 and sum(len(m.languages) for m in parts) == len(whole[0].languages)
    one, many = ({(r.doc_id, r.lang): (r.lang_pred, round(r.score, 9), round(r.bits_per_byte, 9)) for r in identified(docs, m, "lang").collect()} for m in (whole, parts))
    assert one == many and len(one) == len(rows)
    assert all(v[0] == lang for (d, lang), v in one.items() if d is not None and d < 9000) and {one[9000, "long0"][0], one[9001, "long1"][0]} <= {"long0", "long1"}


def test_pieces_are_bounded(spark):
    docs = spark.createDataFrame([(i, "abc def " * 50, "en") for i in range(300)], "doc_id long, text string, lang string")
    (model,) = learn(docs, pieces=5, piece_chars=16)
    assert int(model.codes[0].size) <= 7
