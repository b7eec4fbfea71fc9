"""Personal data: base spans by rule, and more by candidate generators and boosted trees; DataFrame functions only.

Base spans (emails, IP addresses, card numbers, phone numbers) are fixed by patterns and checks.  High-recall generators
propose further spans, which may overlap: obfuscated emails, IPv6 addresses, short card numbers, local phone numbers, and
secrets (keys and tokens, a kind of their own).  Boosted trees over format and context features score these; a threshold per kind,
calibrated for precision on examples kept apart, selects; none that touches a base span stays, and of a run of overlapping ones the
best.  The trees learn from examples built here by rule, and run as conditional expressions.

Patterns run in linear time with constant stack on any text: separators inside numbers and dots inside host names first
become marks of the same length, so that no repeated group is needed.  Positions, overlaps and replacements are settled on sorted
arrays by running sums and maxima in blocks (n ** 1.5 steps for n spans in one text, no pairs).

Defined results: a null text counts as empty; no span gives the sha256 of the empty string; repeated rows each get their row;
very long texts are searched whole; of equally likely overlapping candidates the first, then the longer, then that of the earlier
kind stays; ids may be null; an empty table gives an empty result; columns beyond doc_id and text are ignored unless asked for.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.textops import documents, let

KINDS = ("email", "ip", "card", "phone")
#: The kinds of all spans: those of the base, and one that only the generators propose.
ALL_KINDS = (*KINDS, "secret")
OPEN, CLOSE, GAP, DOT, OTHER = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
CONTEXT = 24

LOCAL = f"A-Za-z0-9._%+{DOT}-"
HOST = "A-Za-z0-9-"
# A match starts where a run starts, or where the last match ended: elsewhere in a run the longest match has already failed.
EMAIL = f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@(?=[{HOST}]++{DOT})[{HOST}{DOT}]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = f"[0-9][0-9{GAP}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of further candidates: kind, pattern.  Their lengths are bounded.
TOKEN = "A-Za-z0-9+/_-"
GENERATORS = (
    (0, f"(?<![{LOCAL}])[A-Za-z0-9._%+-]{{1,64}}\\x20?[(\\[]at[)\\]]\\x20?[{HOST}]{{1,63}}(?:\\x20?(?:[(\\[]dot[)\\]]|[.{DOT}])\\x20?[{HOST}]{{1,63}}){{1,6}}"),
    (0, f"(?<![{LOCAL}])[A-Za-z0-9._%+-]{{1,64}}\\x20(?:at|AT)\\x20[{HOST}]{{1,63}}(?:\\x20(?:dot|DOT)\\x20[{HOST}]{{2,63}}){{1,4}}"),
    (1, r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])"),
    (2, f"(?<![0-9{GAP}])[0-9](?:[0-9{GAP}]){{12,17}}(?![0-9{GAP}])"),
    (3, r"(?<![0-9+.-])(?:\([0-9]{2,4}\)[\x20-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])"),
    (4, f"(?<![.{TOKEN}])[{TOKEN}]{{20,200}}={{0,2}}(?![=.{TOKEN}])"),
)
GUARDS = (r"[(\[]at[)\]]", r"\x20(?:dot|DOT)\x20", r":[0-9A-Fa-f]{0,4}:", r"[0-9]", r"[0-9][\x20.)-]{1,2}[0-9]", f"[{TOKEN}]{{20}}")
SPAN = "struct<s:int,e:int,m:string,l:string,r:string>"


def running(values: Column, op, zero: Column) -> Column:
    """op over the values up to each place, of a non-empty array: within blocks of about sqrt(n) values, then over the blocks."""
    kind = zero

    def scanned(part: Column, inclusive: bool) -> Column:
        none = F.struct(kind.alias("now"), F.filter(F.array(kind), lambda x: x != x).alias("out"))
        take = (lambda a, x: op(a["now"], x)) if inclusive else (lambda a, x: a["now"])
        return F.aggregate(part, none, lambda a, x: F.struct(op(a["now"], x).alias("now"), F.concat(a["out"], F.array(take(a, x))).alias("out")), lambda a: a["out"])

    def whole(v: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda i: F.slice(v, i * block + 1, block))
        return let(F.transform(blocks, lambda b: scanned(b, True)), lambda own: F.flatten(F.zip_with(own, scanned(F.transform(own, lambda b: F.element_at(b, -1)), False), lambda b, o: F.transform(b, lambda x: op(o, x)))))

    return let(values, whole)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running_sum(v: str) -> str:
    """``running`` for sums of ints, as SQL; v is a name."""
    scan = lambda part, take: f"aggregate({part}, named_struct('now', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('now', a.now + x, 'out', concat(a.out, array({take}))), a -> a.out)"
    block = f"cast(ceil(sqrt(size({v}))) as int)"
    blocks = f"transform(sequence(0, cast(floor((size({v}) - 1) / {block}) as int)), i -> slice({v}, i * {block} + 1, {block}))"
    sums = f"flatten(zip_with(own, {scan('transform(own, b -> element_at(b, -1))', 'a.now')}, (b, o) -> transform(b, x -> o + x)))"
    return _let(f"transform({blocks}, b -> {scan('b', 'a.now + x')})", "own", sums)


def matches(text: str, pattern: str) -> Column:
    """Array of (s, e, m, l, r): start and end in code points, the match, up to CONTEXT characters before it and one after.

    text: the name of a column.  The expression is SQL, parsed at once: as columns it would be thousands of calls, which took longer than the search."""
    parts = f"split(regexp_replace({text}, r'{pattern}', '{OPEN}$0{CLOSE}'), '{OPEN}')"
    lengths = "transform(p, (x, i) -> char_length(x) - CASE WHEN i > 0 THEN 1 ELSE 0 END)"
    both = "zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (f, o) -> named_struct('before', f, 'own', o))"
    match = f"substring_index(x.own, '{CLOSE}', 1)"
    left, right = f"right(substring_index(x.before, '{CLOSE}', -1), {CONTEXT})", f"left(substring_index(x.own, '{CLOSE}', -1), 1)"
    span = f"named_struct('s', t, 'e', t + char_length({match}), 'm', {match}, 'l', {left}, 'r', {right})"
    spans = f"zip_with({both}, slice({_let(lengths, 'v', _running_sum('v'))}, 1, size(p) - 1), (x, t) -> {span})"
    return F.expr(_let(parts, "p", f"CASE WHEN size(p) > 1 THEN {spans} ELSE cast(array() as array<{SPAN}>) END"))


def _before(values: Column, first: Column) -> Column:
    """The values moved one place on, behind ``first``."""
    return let(values, lambda v: F.concat(F.array(first), F.slice(v, F.lit(1), F.size(v) - 1)))


def clusters(spans: Column) -> Column:
    """Array of (s, e, k): the unions of overlapping spans of a non-empty array of (s, e, k), in order, each with the kind of its first span."""

    def whole(v: Column) -> Column:
        def cut(reach: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
            firsts = F.filter(F.zip_with(v, before, lambda x, b: F.struct(x["s"].alias("s"), b.alias("b"), x["k"].alias("k"))), lambda x: x["s"] >= x["b"])
            return let(firsts, lambda f: F.zip_with(f, F.concat(F.transform(F.slice(f, F.lit(2), F.size(f)), lambda x: x["b"]), F.array(F.element_at(reach, -1))), lambda x, e: F.struct(x["s"].alias("s"), e.alias("e"), x["k"].alias("k"))))

        return let(running(F.transform(v, lambda x: x["e"]), F.greatest, F.lit(0)), cut)

    return let(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))), whole)


def untouched(candidates: Column, base: Column) -> Column:
    """The candidates (k, s, e, p) that overlap none of the base spans (k, s, e); both not empty."""
    far = F.lit(2**31 - 1)
    event = lambda x, t, p: F.struct(x["s"].alias("s"), F.lit(t).alias("t"), x["e"].alias("e"), x["k"].alias("k"), p.alias("p"))
    every = F.array_sort(F.concat(F.transform(base, lambda x: event(x, 0, F.lit(0.0))), F.transform(candidates, lambda x: event(x, 1, x["p"]))))

    def whole(v: Column) -> Column:
        reach = running(F.transform(v, lambda x: F.when(x["t"] == 0, x["e"]).otherwise(F.lit(0))), F.greatest, F.lit(0))
        ahead = F.reverse(running(F.reverse(F.transform(v, lambda x: F.when(x["t"] == 0, x["s"]).otherwise(far))), F.least, far))
        marked_ = F.zip_with(F.zip_with(v, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), ahead, lambda y, a: F.struct(y["x"].alias("x"), ((y["x"]["t"] == 1) & (y["r"] <= y["x"]["s"]) & (a >= y["x"]["e"])).alias("ok")))
        return F.transform(F.filter(marked_, lambda y: y["ok"]), lambda y: F.struct(y["x"]["k"].alias("k"), y["x"]["s"].alias("s"), y["x"]["e"].alias("e"), y["x"]["p"].alias("p")))

    return let(every, whole)


def best_apart(candidates: Column) -> Column:
    """Of each run of overlapping candidates (k, s, e, p) the most likely, as (k, s, e); not for an empty array."""

    def whole(v: Column) -> Column:
        reach = _before(running(F.transform(v, lambda x: x["e"]), F.greatest, F.lit(0)), F.lit(0))
        run = running(F.zip_with(v, reach, lambda x, r: F.when(x["s"] >= r, 1).otherwise(0)), _plus, F.lit(0))
        ranked = F.array_sort(F.zip_with(v, run, lambda x, n: F.struct(n.alias("n"), (-x["p"]).alias("q"), x["s"].alias("s"), (-x["e"]).alias("f"), x["k"].alias("k"))))
        first = lambda r: F.filter(F.zip_with(r, _before(F.transform(r, lambda x: x["n"]), F.lit(0)), lambda x, n: F.struct(x.alias("x"), (x["n"] != n).alias("ok"))), lambda y: y["ok"])
        return F.transform(let(ranked, first), lambda y: F.struct(y["x"]["k"].alias("k"), y["x"]["s"].alias("s"), (-y["x"]["f"]).alias("e")))

    return let(F.array_sort(F.transform(candidates, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["p"].alias("p")))), whole)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    n = F.length(d)

    def add(a: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return a + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def _valid(kind: int, m: Column) -> Column:
    if kind == 1:
        # Up to three digits after leading zeros, so that no part is too long for a number.
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.nullif(F.ltrim(F.right(p, F.lit(3)), F.lit("0")), F.lit("")), F.lit("0")).cast("int") <= 255))
    if kind == 2:
        return F.length(digits(m)).between(16, 19) & F.when(F.length(digits(m)).between(16, 19), luhn(digits(m))).otherwise(False)
    if kind == 3:
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def _checked(kind: int):
    return lambda x: _valid(kind, x["m"])


def marked(text: Column) -> Column:
    """The text without the characters that serve as marks here; others of the same length take their place."""
    return F.when(text.rlike(f"[{OPEN}-{DOT}]"), F.translate(text, OPEN + CLOSE + GAP + DOT, OTHER * 4)).otherwise(text)


def searchable(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The columns ``keep``, and the forms of the text that are searched: text_, gaps_ (separators inside numbers are marks; null without digits) and dots_ (dots inside host
    names are; null without an @)."""
    own = rows.select(*keep, marked(F.coalesce(text, F.lit(""))).alias("text_"))
    gaps = F.when(F.col("text_").rlike("[0-9]"), F.regexp_replace("text_", r"(?<=[0-9])[\x20-](?=[0-9])", GAP))
    dots = F.when(F.contains("text_", F.lit("@")), F.regexp_replace("text_", f"(?<=[{HOST}])\\.(?=[{HOST}])", DOT))
    return own.select(*keep, "text_", gaps.alias("gaps_"), dots.alias("dots_"))


def base_spans() -> dict[str, Column]:
    """For each kind, an array of (s, e, m, l, r), from the columns of ``searchable``."""
    text, empty = F.col("text_"), F.expr(f"cast(array() as array<{SPAN}>)")
    found = {"email": F.when(F.col("dots_").isNotNull(), matches("dots_", EMAIL)), "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), matches("text_", IP)), "card": F.when(F.col("gaps_").isNotNull(), matches("gaps_", CARD)), "phone": F.when(text.rlike(r"\+[0-9]"), matches("text_", PHONE))}
    return {k: F.coalesce(F.filter(v, _checked(i)), empty) for i, (k, v) in enumerate(found.items())}


#: Words before a candidate that speak for each kind, and against any.
HINTS = ("mail|contact|write|reach", "ip|host|address|server|from|ping", "card|visa|amex|credit|payment", "tel|phone|call|fax|mobile|dial|contact", "token|key|secret|passw|pwd|auth|bearer|credential|api")
AGAINST = "order|invoice|isbn|serial|ticket|version|date|part|ref|sku|id|total|page|commit|time|sha|digest|checksum|file|path"
FEATURES = ("kind", "n_digits", "n_chars", "n_seps", "parens", "dots", "brackets", "luhn_ok", "hint", "against", "letter_before", "letter_after", "n_upper", "n_slashes", "assigned", "colons", "double_colon")


def features(c: Column) -> Column:
    """Format and context features of a candidate (kind, m, l, r), as a struct of ints."""
    m, left = c["m"], F.lower(c["l"])
    own = F.element_at(F.array(*(F.lit(f"(?:^|[^a-z])[a-z]*(?:{h})[a-z]*[^a-z]") for h in HINTS)), c["kind"] + 1)
    d = digits(m)
    count = lambda chars: F.char_length(F.regexp_replace(m, f"[^{chars}]", ""))
    values = {
        "kind": c["kind"],
        "n_digits": F.length(d),
        "n_chars": F.char_length(m),
        "n_seps": count(f" .:{GAP}{DOT}-"),
        "parens": F.contains(m, F.lit("(")).cast("int"),
        "dots": count(f".{DOT}"),
        "brackets": m.rlike(r"[(\[](?:at|dot)[)\]]").cast("int"),
        "luhn_ok": F.when(F.length(d).between(13, 19), luhn(d).cast("int")).otherwise(0),
        "hint": F.regexp_like(left, own).cast("int"),
        "against": left.rlike(f"(?:^|[^a-z])(?:{AGAINST})[^a-z]").cast("int"),
        "letter_before": left.rlike("[a-z0-9_]$").cast("int"),
        "letter_after": c["r"].rlike("[A-Za-z0-9_]").cast("int"),
        "n_upper": count("A-Z"),
        "n_slashes": count("/"),
        "assigned": c["l"].rlike("[=:]\\s?[\"']?$").cast("int"),
        "colons": count(":"),
        "double_colon": F.contains(m, F.lit("::")).cast("int"),
    }
    return F.struct(*(F.coalesce(v, F.lit(0)).cast("int").alias(k) for k, v in values.items()))


def _of_kind(kind: int):
    return lambda x: F.struct(F.lit(kind).alias("kind"), *(x[c].alias(c) for c in ("s", "e", "m", "l", "r")))


def proposed() -> Column:
    """Array of (kind, s, e, m, l, r) of all generators, from the columns of ``searchable``."""
    empty = F.expr("cast(array() as array<struct<kind:int,s:int,e:int,m:string,l:string,r:string>>)")
    out = []
    for (kind, pattern), guard in zip(GENERATORS, GUARDS):
        found = F.when(F.col("text_").rlike(guard), matches("gaps_" if kind == 2 else "text_", pattern))
        out.append(F.coalesce(F.transform(found, _of_kind(kind)), empty))
    return F.concat(*out)


@dataclass(frozen=True)
class Tree:
    """Depth two: (feature, threshold) at the root and on both sides, and four leaves; below the threshold goes left."""

    root: tuple[int, float]
    left: tuple[int, float]
    right: tuple[int, float]
    leaves: tuple[float, float, float, float]

    def values(self, x: np.ndarray) -> np.ndarray:
        side = x[:, self.root[0]] >= self.root[1]
        low, high = x[:, self.left[0]] >= self.left[1], x[:, self.right[0]] >= self.right[1]
        return np.where(side, np.where(high, self.leaves[3], self.leaves[2]), np.where(low, self.leaves[1], self.leaves[0]))

    def sql(self, f: str) -> str:
        def branch(cut: tuple[int, float], a: object, b: object) -> str:
            return f"CASE WHEN {f}.{FEATURES[cut[0]]} < {cut[1]!r}D THEN {a} ELSE {b} END"

        leaf = [f"{v!r}D" for v in self.leaves]
        return branch(self.root, branch(self.left, leaf[0], leaf[1]), branch(self.right, leaf[2], leaf[3]))


@dataclass(frozen=True)
class Forest:
    """The boosted trees of one kind, the line that calibrates their margin, and the least probability that selects."""

    bias: float
    trees: tuple[Tree, ...]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((t.values(x) for t in self.trees), np.zeros(len(x)))

    def sql(self, f: str) -> str:
        z = " + ".join([f"{self.bias!r}D", *(t.sql(f) for t in self.trees)])
        return f"1 / (1 + exp(-(({z}) * {self.slope!r}D + {self.shift!r}D)))"


@dataclass(frozen=True)
class Model:
    """One forest for each kind."""

    forests: tuple[Forest, ...]

    def sql(self, kind: str, f: str) -> str:
        """The probability of a candidate of a kind with features ``f``."""
        return f"CASE {kind} {' '.join(f'WHEN {i} THEN {x.sql(f)}' for i, x in enumerate(self.forests))} END"

    def threshold(self, kind: Column) -> Column:
        return F.element_at(F.array(*(F.lit(x.threshold) for x in self.forests)), kind + 1)


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, tuple[int, float]]:
    best, cut = 0.0, (0, -1.0)
    total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for j in range(x.shape[1]):
        values, of = np.unique(x[rows, j], return_inverse=True)
        if len(values) < 2:
            continue
        a, b = (np.cumsum(np.bincount(of, v[rows])) for v in (g, h))
        gain = a[:-1] ** 2 / (b[:-1] + 1) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + 1) - total
        i = int(gain.argmax())
        if gain[i] > best + 1e-9:
            best, cut = float(gain[i]), (j, float(values[i + 1]))
    return best, cut


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 36, rate: float = 0.4) -> tuple[float, list[Tree]]:
    """Newton boosting of the logistic loss by trees of depth two."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(math.log(p / (1 - p)))
    z, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-z))
        g, h = q - y, q * (1 - q)
        rows = np.arange(len(y))
        gain, root = _split(x, g, h, rows)
        if gain <= 1e-6:
            break
        side = x[:, root[0]] >= root[1]
        cuts, leaves = [], []
        for part in (rows[~side], rows[side]):
            _, cut = _split(x, g, h, part)
            cuts.append(cut)
            for own in (part[x[part, cut[0]] < cut[1]], part[x[part, cut[0]] >= cut[1]]):
                leaves.append(float(-rate * g[own].sum() / (h[own].sum() + 1)))
        trees.append(Tree(root, cuts[0], cuts[1], tuple(leaves)))
        z = z + trees[-1].values(x)
    return bias, trees


def examples(n: int = 3200, seed: int = 11) -> list[tuple[int, str]]:
    """Labelled lines, built by rule: the number of the kind, from 1, for personal data in forms that the base patterns miss, 0 for look-alikes."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))
    pick = r.choice

    def check_digit(d: str) -> str:
        return next(d + c for c in "0123456789" if sum((2 * int(v) - 9 * (int(v) > 4) if i % 2 else int(v)) for i, v in enumerate(reversed(d + c))) % 10 == 0)

    def grouped(d: str) -> str:
        s = pick(["", " ", "-"])
        return s.join([d[:4], d[4:10], d[10:]]) if len(d) == 15 else s.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        return pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(4)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])

    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    def key() -> str:
        return pick([hexes(pick([32, 40, 64])), mixed(r.randint(24, 48)), "AKIA" + mixed(20).upper(), "ghp_" + mixed(36), "sk-" + mixed(40), mixed(42) + "=="])

    def six() -> str:
        h = [pick(["0", format(r.randrange(1, 16), "x"), format(r.randrange(1, 65536), "x"), format(r.randrange(1, 65536), "x")]) for _ in range(8)]
        a = r.randint(1, 4)
        return pick([":".join(h), f"{':'.join(h[:a])}::{':'.join(h[a : a + r.randint(1, 3)])}", f"fe80::{h[0]}", f"fe80::{r.randint(1, 9)}", f"2001:db8::{h[0]}"])

    def plain_at() -> str:
        return f"{word()}{pick(['', '.' + word()])} at {word()} dot {pick(['com', 'org', 'net', 'de', 'co dot uk'])}"

    good = (
        lambda: f"{pick(['mail', 'contact', 'write to', word()])} {word()} {word()}{pick(['(at)', ' [at] ', '[at]', ' (at) '])}{word()}{pick(['.', ' [dot] ', '(dot)'])}{pick(['com', 'org', 'de'])} {word()}",
        lambda: f"{word()} {pick(['mail', 'email me:', 'contact', 'write to', 'reach me:'])} {plain_at()}, {word()}",
        lambda: f"{word()} {pick(['server', 'from ip', 'host', word()])} {six()} {word()}",
        lambda: f"{word()} {pick(['card', 'visa', 'amex card no', 'payment by'])} {grouped(check_digit(pick(['34', '37']) + num(12)))} {word()}",
        lambda: f"{word()} {pick(['tel', 'call', 'phone:', 'fax', 'mobile', 'dial'])} {phone()} {word()}",
        lambda: f"{word()} {pick(['token', 'api_key', 'secret', 'password', 'AUTH_TOKEN', 'client_secret'])}{pick([' = ', '=', ': '])}{(q := pick(['', chr(34), chr(39)]))}{key()}{q} {word()}",
        lambda: f"{word()} {pick(['Authorization: Bearer', 'bearer', 'api key', 'secret key'])} {key()} {word()}",
    )
    bad = (
        lambda: f"{word()} array{pick(['(at)', '[at]'])}{word()}{pick([' . ', '.'])}{word()}_{word()}",
        lambda: f"{word()} {pick(['meet', word(), 'look'])} {plain_at()} {word()}",
        lambda: f"{word()}_{':'.join(num(2) for _ in range(8))}_{word()}",
        lambda: f"{word()} {pick(['time', 'at', word(), 'from'])} {num(2)}:{num(2)}:{num(2)} {word()}",
        lambda: f"{word()} {pick(['a', 'b', 'f', 'e', ''])}::{pick(['c', 'd', 'add', ''])} {word()}",
        lambda: f"{word()} {pick(['order', 'serial', word(), 'ref', 'card'])} {grouped(num(pick([13, 14, 15, 15, 15])))} {word()}",
        lambda: f"{word()} {pick(['order', 'serial', word(), 'isbn', 'part', word(), word()])} {phone()} {word()}",
        lambda: f"{word()} {pick(['order', 'serial', word(), word()])} {grouped(check_digit(num(pick([12, 13, 14]))))} {word()}",
        lambda: f"{word()} {pick(['commit', 'sha', 'digest', 'checksum', word()])}{pick([' ', ': '])}{hexes(pick([40, 64]))} {word()}",
        lambda: f"{word()} {pick(['file', 'path', 'see', word()])} {word()}/{word()}/{word()}/{word()}/{word()} {word()}",
        lambda: f"{word()} {pick([word(), 'key', 'the token', 'a secret'])} {''.join(word() for _ in range(r.randint(4, 7)))} {word()}",
        lambda: f"{word()} {pick(['the', 'your', word()])} {'_'.join(pick(['secret', 'access', 'key', 'token', word()]) for _ in range(5))} {word()}",
        lambda: f"{word()} {pick([word(), 'secret:', 'token'])} {''.join(word().capitalize() for _ in range(r.randint(4, 7)))} {word()}",
        lambda: f"{word()} {pick([word(), 'api', 'key:'])} {word()}-{word()}-{word()}-{word()}-{word()}-{word()} {word()}",
    )
    kinds = (1, 1, 2, 3, 4, 5, 5)
    return [(kinds[j := r.randrange(len(good))], good[j]()) if i % 2 else (0, pick(bad)()) for i in range(n)]


_LEARNED: dict[float, Model] = {}


def learn(spark: SparkSession, precision: float = 0.98) -> Model:
    """The model of the built examples, learned once per process, as they are always the same."""
    if precision not in _LEARNED:
        _LEARNED[precision] = _learned(spark, precision)
    return _LEARNED[precision]


def _learned(spark: SparkSession, precision: float) -> Model:
    """Learns from the built examples, each kind from its own: three quarters grow the trees; the others calibrate the
    probabilities and give the least threshold of at least 0.5 with the wanted precision."""
    rows = examples()
    listed = F.explode(F.split(F.lit("\n".join(f"{y}{t}" for y, t in rows)), "\n"))
    lines = spark.range(1, numPartitions=1).select(listed.alias("line")).select(F.left("line", F.lit(1)).cast("int").alias("y"), F.expr("substring(line, 2)").alias("text"))
    cells = searchable(lines, F.col("text"), "y").select("y", F.explode(proposed()).alias("c")).select("y", features(F.col("c")).alias("f")).groupBy("y", *(F.col(f"f.{k}").alias(k) for k in FEATURES)).count().collect()
    cells.sort(key=tuple)
    x = np.array([[c[k] for k in FEATURES] for c in cells for _ in range(c["count"])], dtype=float)
    y = np.array([c["y"] == c["kind"] + 1 for c in cells for _ in range(c["count"])], dtype=float)
    return Model(tuple(_fitted(x[x[:, 0] == kind], y[x[:, 0] == kind], precision) for kind in range(len(ALL_KINDS))))


def _fitted(x: np.ndarray, y: np.ndarray, precision: float) -> Forest:
    order = np.random.default_rng(3).permutation(len(y))
    apart, own = order[: len(y) // 4], order[len(y) // 4 :]
    bias, trees = boosted(x[own], y[own])
    z = Forest(bias, tuple(trees)).margin(x[apart])
    slope, shift = min(((a, b) for a in np.linspace(0.2, 2, 19) for b in np.linspace(-2, 2, 21)), key=lambda ab: float(np.mean(np.logaddexp(0, z * ab[0] + ab[1]) - y[apart] * (z * ab[0] + ab[1]))))
    p = 1 / (1 + np.exp(-(z * slope + shift)))
    good = [t for t in np.arange(0.5, 1.0, 0.01) if (p >= t).any() and y[apart][p >= t].mean() >= precision]
    return Forest(bias, tuple(trees), float(slope), float(shift), float(good[0]) if good else 2.0)


def detected(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, base (array of (k, s, e) by kind and start) and spans (the same with the selected candidates)."""
    names = list(dict.fromkeys(["doc_id", *keep]))

    def triple(kind: int):
        return lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"))

    base = F.concat(*(F.transform(v, triple(i)) for i, v in enumerate(base_spans().values())))
    wide = searchable(docs, F.col("text"), *names).select(*names, base.alias("base"), proposed().alias("more"))
    known = wide.withColumn("more", F.transform("more", lambda c: F.struct(c["kind"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), features(c).alias("f"))))
    rated = known.withColumn("more", F.expr(f"transform(more, c -> named_struct('k', c.k, 's', c.s, 'e', c.e, 'p', {model.sql('c.k', 'c.f')}))"))
    taken = rated.withColumn("more", F.filter("more", lambda c: c["p"] >= model.threshold(c["k"])))
    apart = taken.withColumn("more", F.when((F.size("more") > 0) & (F.size("base") > 0), untouched(F.col("more"), F.col("base"))).otherwise(F.col("more")))
    none = F.expr("cast(array() as array<struct<k:int,s:int,e:int>>)")
    extra = F.when(F.size("more") > 0, best_apart(F.col("more"))).otherwise(none)
    return apart.select(*names, "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


#: Texts are cut at spans in blocks of so many characters.
BLOCK = 1024


def redacted(text: Column, spans: str) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced once."""
    label = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL_KINDS))

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        """Characters start..end, from the blocks that hold them."""
        first = F.floor(start / BLOCK).cast("int")
        some = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.substring(some, start - first * BLOCK + 1, end - start)

    def whole(x: Column) -> Column:
        begins = _before(F.transform(x["c"], lambda c: c["e"]), F.lit(0))
        parts = F.zip_with(x["c"], begins, lambda c, b: F.concat(cut(x["b"], b, c["s"]), F.element_at(label, c["k"] + 1)))
        last = F.element_at(x["c"], -1)["e"]
        return F.concat(F.array_join(parts, ""), cut(x["b"], last, F.greatest(last, x["n"])))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    new = let(F.struct(clusters(F.col(spans)).alias("c"), blocks.alias("b"), F.char_length(text).alias("n")), whole)
    return F.when(F.size(spans) == 0, text).otherwise(new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    own = detected(docs, learn(spark))
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return own.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
