import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum((2 * int(v) - 9 * (int(v) > 4) if i % 2 else int(v)) for i, v in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PATTERNS[k], text or "") if valid(k, m[0])]


ODD = [
    None, "", "a@b.c@d.e a@b.cd_e@f.g x@y @z.z a.b@c..d", "1.2.3.4.5.6.7.8 256.1.1.1 0000001.2.3.04 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 1111 1111", "+1 (017) 555-7713 +44 20 7946 0958. +1-2 ++49123456789",
    "é日😀 a@b.co x@y.zz", "9" * 4000, "1 " * 9000 + "x", "a@" + "b." * 9000 + "c", "a" * 50000 + "@b.c", "-@-.-", "1.2.3.4@x.y +1.2.3.4.5.6.7.8", "4242424242424242 " * 800,
]


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(spark)


def test_base_spans_against_brute_force(spark, model):
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["a", "1", "2", ".", "@", "-", " ", "+", "(", ")", "4111", "é", "_", "b.c", "\n", "00", "255.", ""]) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'b' AS base", "'s' AS spans", "'m' AS more", "'t' AS text_")
    out = pii.detected(docs, model, "text").withColumn("sha", F.sha2(pii.listed("base").cast("binary"), 256)).withColumn("listed", pii.listed("spans")).collect()
    assert len(out) == len(texts)
    for row in out:
        want = brute(row.text)
        assert row.sha == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), row.text
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(filter(None, row.listed.split(",")))
    assert pii.detected(docs.limit(0), model).count() == 0


def test_further_spans_and_look_alikes(spark, model):
    good = ["write to jo.doe(at)mail(dot)org now", "jo [at] mail.com", "please call (017) 555-7713 now", "amex card 3782 822463 10005 paid", "server 2001:db8:0:0:0:0:0:1 up", "ping fe80::1 now", "host 2001:db8::8a2e:370 up", "contact jo.doe at mail dot org, please", "token = \"747e8edd6430861f24c6911d38d6f174e76a63b3\"", "api_key=q8Zk2LmW0xYb7TnVr4Ps6QdE end"]
    bad = ["order 555 1234 5678 shipped", "array[at]index", "version 10.12.2020", "isbn 9780306406157", "serial 123456789012345 ok", "commit 747e8edd6430861f24c6911d38d6f174e76a63b3", "at 12:30:45 sharp", "std::vector and a::b", "see some/long/path/to/a/file here", "the number 427004852 in prose", "meet at noon dot com"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    n = {r.doc_id: len(r.spans) for r in pii.detected(docs, model).collect()}
    assert [n[i] for i in range(len(good))] == [1] * len(good)
    assert [n[i + len(good)] for i in range(len(bad))] == [0] * len(bad)


def test_redaction(spark, model):
    docs = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4@x.y!"), (1, "é a@b.co, 1.2.3.4@x.y!"), (None, "clean"), (2, None)], "doc_id long, text string")
    rows = pii.detected(docs, model, "text").select("doc_id", pii.redacted(F.col("text"), "spans").alias("t")).collect()
    assert sorted((str(r.doc_id), str(r.t)) for r in rows) == [("1", "é [EMAIL], [IP]!"), ("1", "é [EMAIL], [IP]!"), ("2", "None"), ("None", "clean")]


def test_many_spans_in_one_text(spark, model):
    """50,000 emails in one text, and 20,000 candidates in another: all are found and replaced (pairs of them would be billions)."""
    mails = " ".join(f"m{i}@h{i % 9}.org" for i in range(50_000))
    calls = " ".join(f"call (017) 555-{i % 9000 + 1000} or m{i}@h.org" for i in range(20_000))
    docs = spark.createDataFrame([(1, mails), (2, calls)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.detected(docs, model, "text").select("doc_id", F.size("base").alias("b"), F.size("spans").alias("n"), pii.redacted(F.col("text"), "spans").alias("t")).collect()}
    assert rows[1].b == rows[1].n == 50_000 and rows[1].t == " ".join(["[EMAIL]"] * 50_000)
    assert rows[2].b == 20_000 and rows[2].n == 40_000 and rows[2].t == " ".join(["call [PHONE] or [EMAIL]"] * 20_000)


def test_overlaps_against_pairs(spark):
    """Arrays of spans: what touches a base span goes, and of each run of overlapping candidates the best stays."""
    r = random.Random(3)
    rows = []
    for i in range(200):
        spans = lambda n, p: [(r.randrange(4), s := r.randrange(60), s + r.randint(1, 6), *([round(r.random(), 2)] if p else [])) for _ in range(n)]
        rows.append((i, spans(r.randint(1, 9), False), spans(r.randint(1, 12), True)))
    frame = spark.createDataFrame(rows, "i int, base array<struct<k:int,s:int,e:int>>, more array<struct<k:int,s:int,e:int,p:double>>")
    out = frame.select("i", pii.untouched(F.col("more"), F.col("base")).alias("u"), pii.best_apart(F.col("more")).alias("b"), pii.clusters(F.col("base")).alias("c")).collect()
    for (i, base, more), row in zip(rows, sorted(out)):
        assert sorted(map(tuple, row.u)) == sorted(c for c in more if not any(b[1] < c[2] and c[1] < b[2] for b in base))
        runs, reach = [], -1
        for c in sorted(more, key=lambda c: (c[1], c[2], c[0], c[3])):
            if c[1] >= reach:
                runs.append([])
            runs[-1].append(c)
            reach = max(reach, c[2])
        assert sorted(map(tuple, row.b)) == sorted(min(x, key=lambda c: (-c[3], c[1], -c[2], c[0]))[:3] for x in runs)
        covered = {p for b in base for p in range(b[1], b[2])}
        assert {p for c in row.c for p in range(c.s, c.e)} == covered and all(a.e <= b.s for a, b in zip(row.c, row.c[1:]))


def test_precision_and_recall_on_other_examples(spark, model):
    """Built by the same rules from another seed; the figures stand in the README."""
    rows = pii.examples(2000, seed=77)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    base = {}
    for d in pii.detected(docs, model).collect():
        base[d.doc_id] = [x.k for x in d.spans]
    hit = sum(bool(base[i]) for i, (y, _) in enumerate(rows) if y)
    wrong = sum(bool(base[i]) for i, (y, _) in enumerate(rows) if not y)
    assert hit >= 0.85 * sum(y > 0 for y, _ in rows) and wrong <= 0.05 * hit
