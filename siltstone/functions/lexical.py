"""Query terms and the hybrid score, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results depend on exactly these words and weights.
STOPWORDS = ("a", "an", "and", "are", "do", "does", "for", "how", "i", "in", "is", "it", "me", "of", "on", "or", "show", "the", "to", "what", "where")
IMPLEMENTATION_TERMS = ("implemented", "implementation", "implement", "implements", "how", "where")
LOOKUP_TERMS = ("bean", "find", "get", "getbean", "inject", "lookup", "resolve", "resolvebean", "resolvebeanregistration", "resolver")
SIGNAL_TERMS = ("findbean", "getbean", "lookup", "resolve", "resolvebean", "resolvebeanregistration")
SYNONYMS = {
    "lookup": ("get", "getbean", "find", "findbean", "resolve", "resolvebean"),
    "implemented": ("implementation", "default"),
    "implementation": ("implemented", "default"),
    "bean": ("beandefinition", "beanregistration"),
}
GENERIC_NAMES = ("annotation", "definitions", "provider", "registry", "scanner")
CALLABLE_KINDS = ("method", "constructor", "behavior")
TERM_WEIGHTS = (("name", 0.45, None), ("symbol", 0.3, None), ("signature", 0.2, 3), ("path", 0.2, 3), ("text", 0.12, 6))
SIGNAL_WEIGHT = 0.35
# End of fixed values.


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(values) -> Column:
    """An array of fixed words, as one parsed expression: a call for each word would take longer than many a query."""
    return F.expr(f"cast(array({', '.join(map(_quoted, values))}) as array<string>)")


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens; a camel-case step starts a new one.  Null has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != "")


def significant(query: Column) -> Column:
    """Distinct tokens of two characters or more that aren't stopwords, in order; if that leaves none, with the stopwords."""
    long = F.filter(tokens(query), lambda t: F.length(t) > 1)
    own = F.array_distinct(F.filter(long, lambda t: ~t.isin(*STOPWORDS)))
    return F.when(F.size(own) > 0, own).otherwise(F.array_distinct(long))


def expanded(terms: Column, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> Column:
    """The terms, then the synonyms of each in order; distinct."""
    table = F.expr(f"map({', '.join(f'{_quoted(k)}, array({', '.join(map(_quoted, v))})' for k, v in synonyms.items())})")
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.element_at(table, t), _none())))
    return F.array_distinct(F.concat(terms, more))


def asks_implementation(terms: Column) -> Column:
    """On unexpanded terms: does the query ask where something is done or looked up?"""
    return F.arrays_overlap(terms, words(dict.fromkeys(IMPLEMENTATION_TERMS + LOOKUP_TERMS)))


def confidence(score: Column) -> Column:
    return F.when(score >= 2.5, "high").when(score >= 1.0, "medium").otherwise("low")


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def summary(text: Column, fallback: Column | None = None) -> Column:
    """White space collapsed; over 200 characters, the first 197 and three dots.  A blank text falls back."""
    own = flat(text)
    if fallback is not None:
        own = F.when(own != "", own).otherwise(flat(fallback))
    return F.when(F.length(own) > 200, F.concat(F.left(own, F.lit(197)), F.lit("..."))).otherwise(own)


def symbol(package: Column, owners: Column, name: Column) -> Column:
    """The qualified name; null without a name."""
    return F.when(F.trim(name) != "", qualified(F.trim(package), owners, F.trim(name)))


def qualified(package: Column, owners: Column, name: Column) -> Column:
    """Package, owners and name, joined by dots; absent parts are left out, and nothing at all is null."""
    parts = F.concat(F.array(package), F.coalesce(owners, _none()), F.array(name))
    return F.nullif(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "."), F.lit(""))


def holds(whole: Column, part: Column) -> Column:
    """Is ``part`` non-empty and in ``whole``, whatever the case?"""
    return F.coalesce((part != "") & F.contains(F.lower(whole), F.lower(part)), F.lit(False))


def bias(kind: Column, name: Column, modifiers: Column, source: Column, text: Column, name_terms: Column, terms: Column) -> list[tuple[Column, Column, Column]]:
    """(condition, delta, reason) of each step of the implementation bias, in order."""
    source, text, low = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    padded = F.concat(F.lit(" "), source, F.lit(" "))
    code = kind.isin(*CALLABLE_KINDS)
    has = lambda where, *parts: reduce(lambda a, b: a | b, (F.contains(where, F.lit(p)) for p in parts))
    of_type = (
        F.when(kind != "type", F.lit(0.0))
        .when(has(source, "@interface"), F.lit(-1.2))
        .when(has(padded, " interface "), F.lit(-0.75))
        .when(F.array_contains(F.coalesce(modifiers, _none()), "abstract") | has(padded, " abstract class "), F.lit(-0.35))
        .when(has(source, " class ", " record ", " enum "), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )
    type_reason = F.when(of_type == -1.2, "implementation:annotation_penalty").when(of_type == -0.75, "implementation:interface_penalty").when(of_type == -0.35, "implementation:abstract_penalty").otherwise("implementation:concrete_type")
    looks = F.arrays_overlap(terms, words(LOOKUP_TERMS))
    return [
        (code, F.lit(0.7), F.lit("implementation:callable")),
        (~code & (of_type != 0), of_type, type_reason),
        (F.coalesce(name.startswith("Default"), F.lit(False)), F.lit(0.3), F.lit("implementation:default_impl")),
        (looks & has(low, "get", "find", "lookup", "resolve"), F.lit(0.35), F.lit("implementation:resolver_name")),
        (looks & has(text, "getbean", "resolve", "lookup", "find"), F.lit(0.15), F.lit("implementation:resolver_text")),
        (looks & (kind == "type") & F.arrays_overlap(name_terms, words(GENERIC_NAMES)), F.lit(-0.45), F.lit("implementation:generic_type_penalty")),
        (looks & has(low, "provider"), F.lit(-0.25), F.lit("implementation:provider_penalty")),
    ]


PARTS = ("name", "symbol", "signature", "path", "text")
LABELS = {"name": "name_terms:", "symbol": "symbol_terms:", "signature": "signature_terms:", "path": "path_terms:", "text": "terms:"}


def term_sets(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds the distinct tokens of each of PARTS, as h_set_ columns, for ``hybrid``."""
    return rows.withColumns({f"h_set_{k}": F.array_distinct(tokens(columns[k])) for k in PARTS})


def query_terms(rows: DataFrame, query: Column) -> DataFrame:
    """Adds the terms of a query, with and without synonyms, for ``hybrid``."""
    own = rows.withColumn("h_own", significant(F.trim(query)))
    return own.withColumns({"h_terms": expanded(F.col("h_own")), "h_asks": asks_implementation(F.col("h_own"))})


def hybrid(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds score and why_matched: the semantic score with the lexical boosts added in a fixed order, and what was added.

    columns: query, semantic, name, symbol, signature, path, text, kind, modifiers and source, none of them null but modifiers.
    What ``term_sets`` and ``query_terms`` have added beforehand is taken from there; the rest is tokenised here, each text once.
    """
    kept = [c for c in rows.columns if not c.startswith("h_")]
    wide = rows.withColumns({f"h_{k}": v for k, v in columns.items()}).withColumn("h_query", F.trim("h_query"))
    wide = wide if "h_own" in rows.columns else query_terms(wide, F.col("h_query"))
    wide = wide if "h_set_text" in rows.columns else term_sets(wide, {k: F.col(f"h_{k}") for k in PARTS})
    wide = wide.withColumns({f"h_common_{k}": F.array_sort(F.array_intersect("h_terms", f"h_set_{k}")) for k in PARTS})
    wide = wide.withColumn("h_signal", F.array_intersect("h_common_text", words(SIGNAL_TERMS)))
    query, name, symbol_, signature, text = (F.col(f"h_{k}") for k in ("query", "name", "symbol", "signature", "text"))
    same = F.coalesce((name != "") & (F.lower(query) == F.lower(name)), F.lit(False))
    steps = [
        (same, F.lit(1.0), F.concat(F.lit("name:"), name)),
        (~same & holds(query, name), F.lit(0.4), F.concat(F.lit("name_fragment:"), name)),
        (holds(query, symbol_), F.lit(0.8), F.concat(F.lit("symbol:"), symbol_)),
        (holds(signature, query), F.lit(0.6), F.lit("signature")),
    ]
    for key, weight, most in TERM_WEIGHTS:
        common = F.col(f"h_common_{key}")
        n = F.size(common)
        steps.append((n > 0, (F.least(n, F.lit(most)) if most else n) * F.lit(weight), F.concat(F.lit(LABELS[key]), F.array_join(common, ", "))))
    steps.append((F.size("h_signal") > 0, F.size("h_signal") * F.lit(SIGNAL_WEIGHT), F.concat(F.lit("lookup_terms:"), F.array_join("h_signal", ", "))))
    steps.append((holds(text, query), F.lit(0.6), F.lit("query_phrase")))
    steps += [(F.col("h_asks") & c, d, r) for c, d, r in bias(F.col("h_kind"), name, F.col("h_modifiers"), F.col("h_source"), text, F.col("h_set_name"), F.col("h_terms"))]
    wide = wide.withColumns({f"h_step_{i}": F.when(c, d) for i, (c, d, _) in enumerate(steps)})
    taken = [F.col(f"h_step_{i}") for i in range(len(steps))]
    score = reduce(lambda total, delta: total + F.coalesce(delta, F.lit(0.0)), taken, F.col("h_semantic").cast("double"))
    reasons = F.filter(F.array(F.lit("semantic"), *(F.when(t.isNotNull(), r) for t, (_, _, r) in zip(taken, steps))), lambda r: r.isNotNull())
    return wide.select(*kept, score.alias("score"), reasons.alias("why_matched"))
