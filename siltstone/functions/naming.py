"""Names, identities and text assembly, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.lexical import qualified

# Fixed values.
INDEXABLE_KINDS = ("type", "skeleton", "method", "constructor", "field", "constant", "behavior")
POSITIONAL_KINDS = ("behavior", "skeleton")
LEAST_CHARS = 20
SEGMENT_CHARS = 4096
# End of fixed values.

STRINGS = "cast(array() as array<string>)"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def package_name(declaration: Column) -> Column:
    """``package a.b;`` -> a.b; null if nothing is left."""
    return blank_to_null(F.trim(F.regexp_replace(F.regexp_replace(declaration, "^package ", ""), ";+$", "")))


def relative_path(path: Column, root: Column) -> Column:
    """The path under the root; outside it an error."""
    under = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(under, F.substr(path, F.length(root) + 2)).otherwise(F.raise_error(F.concat(F.lit("path outside the repository: "), path)).cast("string"))


def display_name(kind: Column, name: Column, owners: Column) -> Column:
    """Behaviours have none; a constructor without one has its type's."""
    return F.when(kind == "behavior", F.lit(None).cast("string")).when(kind == "constructor", F.coalesce(name, F.try_element_at(owners, F.lit(-1)))).otherwise(name)


def signature(kind: Column, name: Column, parameters: Column, return_type: Column, modifiers: Column, throws: Column | None = None) -> Column:
    """Modifiers, return type, name and parameters of methods and constructors; with ``throws`` their clause too."""
    words = blank_to_null(F.array_join(modifiers, " "))
    head = F.concat(name, parameters)
    clause = F.when(F.size(throws) > 0, F.concat(F.lit("throws "), F.array_join(throws, " "))) if throws is not None else None
    parts = lambda *x: F.trim(F.concat_ws(" ", *x, *([clause] if clause is not None else [])))
    known = (name != "") & (parameters != "")
    return F.when((kind == "method") & known & (return_type != ""), parts(words, return_type, head)).when((kind == "constructor") & known, parts(words, head))


def class_name(entry: Column) -> Column:
    """Qualified name of a class file entry; null for module-info, package-info, and classes with an all-digit part."""
    stem = F.regexp_replace(entry, r"\.class$", "")
    parts = F.filter(F.split(F.translate(stem, "$", "/"), "/"), lambda p: p != "")
    info = F.element_at(F.split(stem, "/"), -1).isin("module-info", "package-info")
    inner = F.split(F.element_at(F.split(stem, "/"), -1), r"\$")
    bad = info | F.exists(inner, lambda p: p.rlike("^[0-9]+$")) | ~entry.endswith(".class")
    return F.when(~bad, blank_to_null(F.array_join(parts, ".")))


def strip_clause(clause: Column, keyword: str) -> Column:
    """The clause without its keyword."""
    return F.trim(F.regexp_replace(clause, f"^(.*?){keyword} ", "$1"))


def split_clause(clause: Column, keyword: str) -> Column:
    """The names of a clause, cut at every comma."""
    return F.filter(F.transform(F.split(F.coalesce(strip_clause(clause, keyword), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")


def label(kind: Column, package: Column, owners: Column, name: Column) -> Column:
    """Qualified name; behaviours go by their owners."""
    none = F.lit(None).cast("string")
    return F.when(kind == "behavior", qualified(package, owners, none)).when(name.isNotNull(), qualified(package, owners, name))


LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"


def declaration(kind: Column, source: Column, signature_: Column) -> Column:
    """The signature; of a skeleton the first line that isn't an annotation; else what stands before the first brace."""
    lines = F.filter(F.transform(F.split(source, LINE_ENDS), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("@"))
    return F.when(signature_.isNotNull(), signature_).when(kind == "behavior", F.lit(None).cast("string")).when(kind == "skeleton", F.try_element_at(lines, F.lit(1))).otherwise(F.trim(F.substring_index(source, "{", 1)))


def retrieval_text(kind: Column, label_: Column, declaration_: Column, annotations: Column, source: Column, segment: Column) -> Column:
    """Lines: [kind] label, declaration, segment, annotations, source; blank ones left out.  A missing label reads None."""
    first = F.trim(F.concat(F.lit("["), kind, F.lit("] "), F.coalesce(label_, F.lit("None"))))
    return F.concat_ws("\n", first, blank_to_null(declaration_), blank_to_null(segment), blank_to_null(F.array_join(annotations, " ")), blank_to_null(source))


def segments(text: Column, most: int = SEGMENT_CHARS) -> Column:
    """Lines gathered greedily into segments of at most ``most`` characters; a longer line is a segment of its own.

    The fold carries one number per segment, not the text: at which line each begins.  The lines are then sliced.
    """
    lines = F.split(text, LINE_ENDS)
    start = F.expr("named_struct('at', 0, 'size', -1, 'begins', cast(array() as array<int>))")

    def step(a: Column, n: Column) -> Column:
        full = (a["size"] < 0) | (a["size"] + n + 1 > most)
        begins = F.when(full, F.concat(a["begins"], F.array(a["at"] + 1))).otherwise(a["begins"])
        return F.struct((a["at"] + 1).alias("at"), F.when(full, n).otherwise(a["size"] + n + 1).alias("size"), begins.alias("begins"))

    def cut(both: Column) -> Column:
        ends = F.concat(F.slice(both["begins"], F.lit(2), F.size(both["begins"])), F.array(F.size(both["lines"]) + 1))
        return F.zip_with(both["begins"], ends, lambda a, b: F.array_join(F.slice(both["lines"], a, b - a), "\n"))

    bound = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), F.aggregate(F.transform(x, F.char_length), start, step, lambda a: a["begins"]).alias("begins")))
    return F.when(text.isNotNull(), F.element_at(F.transform(bound, cut), 1))


def chunk_id(repo_root: Column, file_path: Column, kind: Column, package: Column, owners: Column, name: Column, parameters: Column, position: Column) -> Column:
    """First 12 digits of sha1(root), file, kind and name; the position for kinds without a lasting name."""
    own = F.concat(qualified(package, owners, name), F.when(kind.isin("method", "constructor"), F.regexp_replace(F.coalesce(parameters, F.lit("")), r"\s+", "")).otherwise(F.lit("")))
    suffix = F.when(kind.isin(*POSITIONAL_KINDS) | name.isNull() | (name == ""), position.cast("string")).otherwise(own)
    return F.concat_ws(":", F.substring(F.sha1(repo_root.cast("binary")), 1, 12), file_path, kind, suffix)


def payload(columns: dict[str, str]) -> Column:
    """JSON of the columns, without nulls, empty texts and empty lists.  columns: name -> type."""
    own = []
    for name, kind in columns.items():
        c = F.col(name)
        own.append((blank_to_null(c) if kind == "string" else F.when(F.size(c) > 0, c) if kind.startswith("array") else c).alias(name))
    return F.to_json(F.struct(*own))


def payload_value(payload_: Column | str, name: str) -> Column:
    """A value of a payload as text; null where it was left out."""
    return F.get_json_object(payload_, f"$.{name}")


# --- values of a JSON payload, whatever their types


def _typed(value: Column) -> tuple[Column, Column]:
    return F.schema_of_variant(value), F.try_variant_get(value, "$", "string")


def optional_int(value: Column) -> Column:
    """A variant as a long: whole numbers and truth values as they are, texts as the number they say, anything else as null."""
    kind, text = _typed(value)
    number = F.regexp_extract(text, r"^\s*([+-]?\d+)\s*$", 1)
    return F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(value, "$", "long")).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("long")).when(kind == "STRING", F.nullif(number, F.lit("")).try_cast("long"))


def optional_text(value: Column) -> Column:
    """A variant as text; null stays null."""
    return _typed(value)[1]


def text_list(value: Column) -> Column:
    """The items of a variant's list as texts; anything else is an empty list."""
    return F.coalesce(F.try_variant_get(value, "$", "array<string>"), F.expr(STRINGS))


def annotation_texts(value: Column) -> Column:
    """The texts of a variant's list of annotations: of objects their ``text``, if they have one, of other items the item itself."""
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    text = lambda x: F.when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.nullif(F.try_variant_get(x, "$.text", "string"), F.lit(""))).otherwise(F.try_variant_get(x, "$", "string"))
    return F.filter(F.transform(items, text), lambda t: t.isNotNull())
