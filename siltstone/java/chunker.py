"""Java source to chunk rows.

Declarations are parsed by recursive descent over the tokens; bodies are scanned in order for what is worth a chunk of
its own.  A ``file`` row comes first, then types and members in source order.  Where the grammar leaves a choice, interface
``extends`` counts as ``implements`` clause text, enum members appear in the enum's skeleton, and a classic
``switch`` is a behaviour too.
"""

from __future__ import annotations

import re
from typing import Any

from siltstone.java.lexer import KEYWORDS, MODIFIERS, PRIMITIVES, Source

SMALL_TYPE_BYTES = 1500
TYPE_WORDS = ("class", "interface", "enum", "record", "@interface")
KIND_TEXT = {"class": "class", "interface": "interface", "enum": "enum", "record": "record", "@interface": "annotation type"}
JAVADOC = re.compile(r"/\*\*.*?\*/", re.S)


def parse(code: bytes, filepath: str | None = None) -> list[dict[str, Any]]:
    """The chunk rows of a file, in order.  calls hold heads as written; symbols and local_types are for resolving them."""
    return Parser(Source(code), filepath).run()


class Parser:
    def __init__(self, source: Source, filepath: str | None):
        self.s, self.t, self.path = source, source.tokens, filepath
        self.chunks: list[dict[str, Any]] = []
        self.package: str | None = None
        self.imports: list[str] = []
        self.module: str | None = None
        self.local_types: list[str] = []

    # --- small helpers

    def word(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def text(self, a: int, b: int) -> str:
        """Source text of the tokens a..b, both included."""
        return self.s.text(self.t[a].lo, self.t[b].hi) if a <= b < len(self.t) else ""

    def past(self, i: int) -> int:
        """Index after the bracket that opens at i."""
        return self.s.match[i] + 1 if self.s.match[i] >= i else i + 1

    def past_angles(self, i: int) -> int:
        """Index after type arguments that open at i, if they do."""
        if self.word(i) != "<":
            return i
        depth, k = 0, i
        while k < len(self.t):
            w = self.t[k].text
            if w == "<":
                depth += 1
            elif w and set(w) == {">"}:
                depth -= len(w)
                if depth <= 0:
                    return k + 1
            elif w in (";", "{", "}", ")", "&&", "||") or self.t[k].kind == "text":
                return i
            elif w == "(":
                return i
            k += 1
        return i

    def past_annotation(self, i: int) -> int:
        k = i + 2
        while self.word(k) == "." and self.t[k + 1 : k + 2] and self.t[k + 1].kind == "word":
            k += 2
        return self.past(k) if self.word(k) == "(" else k

    def past_type(self, i: int) -> int:
        """Index after a type that starts at i; i if none does."""
        k = i
        while self.word(k) == "@" and self.word(k + 1) != "interface":
            k = self.past_annotation(k)
        if k >= len(self.t) or self.t[k].kind != "word" or (self.t[k].text in KEYWORDS and self.t[k].text not in PRIMITIVES):
            return i
        k = self.past_angles(k + 1)
        while self.word(k) == "." and k + 1 < len(self.t) and self.t[k + 1].kind == "word" and self.t[k + 1].text not in KEYWORDS:
            k = self.past_angles(k + 2)
        while self.word(k) == "[" and self.word(k + 1) == "]":
            k += 2
        return k + 1 if self.word(k) == "..." else k

    def modifiers(self, i: int) -> tuple[int, list[tuple[int, int]], list[str]]:
        """(index after them, annotation token ranges, keywords) of the modifiers that start at i."""
        annotations, words = [], []
        while i < len(self.t):
            w = self.t[i].text
            if w == "@" and self.word(i + 1) != "interface":
                k = self.past_annotation(i)
                annotations.append((i, k - 1))
                i = k
            elif w in MODIFIERS and not (w == "default" and self.word(i + 1) in (":", "->")) and not (w == "sealed" and self.word(i + 1) in ("=", ".", "(", ";", ",")):
                words.append(w)
                i += 1
            else:
                break
        return i, annotations, words

    def annotation(self, a: int, b: int) -> dict[str, Any]:
        k = a + 1
        while k <= b and self.word(k) != "(":
            k += 1
        name, attributes = self.text(a + 1, k - 1), {}
        if k <= b:
            for x, y in self.parts(k + 1, b):
                if self.word(x + 1) == "=" and self.t[x].kind == "word":
                    attributes[self.word(x)] = self.text(x + 2, y)
                elif x <= y:
                    attributes["value"] = self.text(x, y)
        return {"text": self.text(a, b), "name": name, "attributes": attributes}

    def parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """Token ranges between commas from a up to, not including, b."""
        out, start, k = [], a, a
        while k < b:
            w = self.t[k].text
            if w in ("(", "[", "{"):
                k = self.past(k)
                continue
            if w == "<" and (end := self.past_angles(k)) > k:
                k = end
                continue
            if w == ",":
                out.append((start, k - 1))
                start = k + 1
            k += 1
        if start < b:
            out.append((start, b - 1))
        return [(x, y) for x, y in out if x <= y]

    # --- emitting

    def emit(self, kind: str, a: int, b: int, owners: list[str], enclosing: dict[str, Any] | None, **values: Any) -> dict[str, Any]:
        lo, hi = self.t[a].lo, self.t[b].hi
        (l0, c0), (l1, c1) = self.s.point(lo), self.s.point(hi)
        row = {"kind": kind, "owner_chain": list(owners), "filepath": self.path, "span": {"lo": lo, "hi": hi}, "start_line": l0, "start_col": c0, "end_line": l1, "end_col": c1, "text": self.s.text(lo, hi), "name": None} | values
        return self.add(row, enclosing)

    def add(self, row: dict[str, Any], enclosing: dict[str, Any] | None) -> dict[str, Any]:
        owner, label = ".".join(row["owner_chain"]) or "-", row.get("name") or "-"
        row["chunk_id"] = f"{self.path or '<memory>'}:{row['kind']}:{owner}:{label}:{row['span']['lo']}:{row['span']['hi']}"
        row["parent_chunk_id"] = enclosing["chunk_id"] if enclosing else None
        row["type_span"] = enclosing["span"] if enclosing else None
        row["chunk_ord"] = len(self.chunks)
        self.chunks.append(row)
        return row

    def header(self, owners: list[str], fields: list[str]) -> str:
        parts = [f"// file: {self.path}" if self.path else "", f"// {self.package}" if self.package else "", f"// class: {'.'.join(owners)}" if owners else "", f"// fields: {', '.join(fields)}" if fields else ""]
        text = "\n".join(p for p in parts if p)
        return f"{text}\n" if text else ""

    @staticmethod
    def commented(comment: str | None) -> dict[str, Any]:
        found = JAVADOC.search(comment) if comment else None
        return {"leading_comment": comment, "javadoc": found[0] if found else None}

    # --- file

    def run(self) -> list[dict[str, Any]]:
        starts, i = [], 0
        while i < len(self.t):
            w = self.t[i].text
            k, _, _ = self.modifiers(i)
            if self.word(k) == "package" and self.package is None:
                end = self.until(k, ";")
                self.package = self.text(k, end)
                i = end + 1
            elif w == "import":
                end = self.until(i, ";")
                self.imports.append(self.text(i, end))
                i = end + 1
            elif self.word(k) in ("module", "open") and (self.word(k) == "module" or self.word(k + 1) == "module"):
                body = next((j for j in range(k, len(self.t)) if self.word(j) == "{"), None)
                end = self.past(body) - 1 if body is not None else len(self.t) - 1
                self.module = self.text(i, end)
                i = end + 1
            else:
                starts.append(i)
                head = self.type_head(i)
                if head:
                    self.local_types.append(head["name"])
                    i = head["end"] + 1
                else:
                    i = self.past_junk(i)
        n = len(self.s.code)
        (l1, c1) = self.s.point(n)
        text = self.s.text(0, n)
        self.add({"kind": "file", "name": None, "owner_chain": [], "filepath": self.path, "span": {"lo": 0, "hi": n}, "start_line": 1, "start_col": 1, "end_line": l1, "end_col": c1, "text": text, "embed_text": text, "package": self.package, "imports": self.imports, "module": self.module, "local_types": self.local_types}, None)
        for i in starts:
            head = self.type_head(i)
            if head:
                self.type_(head, [], None)
            elif self.word(i) != ";":
                self.emit("parse_error", i, max(i, self.past_junk(i) - 1), [], None)
        known = {(c["span"]["lo"], c["span"]["hi"]) for c in self.chunks if c["kind"] == "parse_error"}
        for i in self.s.broken:
            if (self.t[i].lo, self.t[i].hi) not in known:
                self.emit("parse_error", i, i, [], None)
        return self.chunks

    def until(self, i: int, end: str) -> int:
        while i < len(self.t) - 1 and self.t[i].text != end:
            i += 1
        return i

    def past_junk(self, i: int) -> int:
        """Index after a statement-like run at file or class level that isn't a declaration."""
        start = i
        while i < len(self.t):
            w = self.t[i].text
            if w == ";":
                return i + 1
            if w == "{":
                return self.past(i)
            if w in ("(", "["):
                i = self.past(i)
                continue
            if i > start and self.type_head(i):
                return i
            i += 1
        return i

    # --- types

    def type_head(self, i: int) -> dict[str, Any] | None:
        """The head of a type declaration that starts at i, with its clauses and body; None if none does."""
        k, annotations, words = self.modifiers(i)
        w = self.word(k)
        if w == "@" and self.word(k + 1) == "interface":
            word, name = "@interface", k + 2
        elif w in ("class", "interface", "enum") or w == "record" and k + 1 < len(self.t) and self.t[k + 1].kind == "word" and self.word(k + 2) in ("(", "<"):
            word, name = w, k + 1
        else:
            return None
        if name >= len(self.t) or self.t[name].kind != "word":
            return None
        out: dict[str, Any] = {"start": i, "word": word, "name": self.word(name), "annotations": annotations, "modifiers": words, "components": None, "extends": None, "implements": None, "permits": None, "type_parameters": None}
        j = self.past_angles(name + 1)
        if j > name + 1:
            out["type_parameters"] = self.text(name + 1, j - 1)
        if word == "record" and self.word(j) == "(":
            out["components"] = (j, self.s.match[j])
            j = self.past(j)
        while j < len(self.t) and self.word(j) != "{":
            w = self.word(j)
            if w in ("extends", "implements", "permits"):
                end = j + 1
                while end < len(self.t) and self.word(end) not in ("{", ";", "implements", "permits", "extends"):
                    end += 1
                out["implements" if w == "extends" and word == "interface" else w] = self.text(j, end - 1)
                j = end
            elif w in (";", "}"):
                return None
            else:
                j += 1
        if j >= len(self.t):
            return None
        out["body"], out["end"] = j, self.past(j) - 1
        return out

    def type_(self, head: dict[str, Any], owners: list[str], enclosing: dict[str, Any] | None) -> None:
        a, b, name = head["start"], head["end"], head["name"]
        comment = self.s.comment_before(self.t[a].lo)
        members = self.members(head)
        annotations = [self.annotation(*r) for r in head["annotations"]]
        components = self.components(head)
        about = {"type_kind": KIND_TEXT[head["word"]], "annotations": annotations, "modifiers": head["modifiers"], "is_exception": any(x in (head["extends"] or "") for x in ("Exception", "Error", "Throwable"))} | {k: head[k] for k in ("extends", "implements", "permits", "type_parameters")}
        header = self.header(owners, [])
        note = f"{comment}\n" if comment else ""
        node = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration", "@interface": "annotation_type_declaration"}[head["word"]]
        if self.t[b].hi - self.t[a].lo <= SMALL_TYPE_BYTES:
            raw = self.text(a, b)
            self.emit("type", a, b, owners, enclosing, name=name, text=note + raw, embed_text=header + note + raw, node_type=node, **about, **self.commented(comment))
        fields = [self.text(m["start"], m["end"]).strip() for m in members if m["what"] in ("field", "constant")]
        signatures = [self.signature(m) for m in members if m["what"] in ("method", "constructor")]
        constants = [m["name"] for m in members if m["what"] == "enum_constant"]
        lines = [x["text"] for x in annotations]
        listed = f"({', '.join(f'{c["type"]} {c["name"]}' for c in components)})" if components else None
        lines.append(" ".join(p for p in [*head["modifiers"], KIND_TEXT[head["word"]], name, head["type_parameters"], listed, head["extends"], head["implements"], head["permits"]] if p))
        lines += [f"  // enclosing: {'.'.join(owners)}"] if owners else []
        lines += [f"  constants: {', '.join(constants)}"] if constants else []
        lines += [f"  {x}" for x in fields + signatures]
        text = "\n".join(lines)
        own = self.emit("skeleton", a, b, owners, enclosing, name=name, text=text, embed_text=note + header + text, node_type=node, fields=fields, method_signatures=signatures, enum_constants=constants, record_components=components, **about, **self.commented(comment))
        chain, names, types = [*owners, name], [], []
        for c in components:
            names.append(c["name"])
            types.append({"name": c["name"], "type": c["type"]})
            self.emit("record_component", a, b, chain, own, name=c["name"], text=f"{c['type']} {c['name']}", embed_text=self.header(chain, names) + f"{c['type']} {c['name']}", node_type="record_component", component_type=c["type"])
        for m in members:
            if m["what"] in ("field", "constant"):
                names += [d for d in m["names"] if d not in names]
                types += [{"name": d, "type": m["type"]} for d in m["names"]]
        self.member_chunks(members, chain, own, names, types)

    def components(self, head: dict[str, Any]) -> list[dict[str, str]]:
        if not head["components"]:
            return []
        a, b = head["components"]
        return [{"name": self.word(y), "type": self.text(x, y - 1)} for x, y in ((self.modifiers(x)[0], y) for x, y in self.parts(a + 1, b)) if x < y]

    def signature(self, m: dict[str, Any]) -> str:
        end = (m["body"] - 1) if m["body"] is not None else m["end"] - (self.word(m["end"]) == ";")
        return " ".join(self.text(m["start"], end).split())

    # --- members

    def members(self, head: dict[str, Any]) -> list[dict[str, Any]]:
        return self.members_between(head["body"] + 1, head["end"], head["word"], head["name"])

    def members_between(self, i: int, end: int, word: str = "class", type_name: str | None = None) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = []
        if word == "enum":
            i = self.constants(i, end, out)
        while i < end:
            if self.word(i) == ";":
                i += 1
                continue
            m = self.member(i, end, word, type_name)
            out.append(m)
            i = m["end"] + 1
        return out

    def constants(self, i: int, end: int, out: list[dict[str, Any]]) -> int:
        while i < end:
            start = i
            i, annotations, _ = self.modifiers(i)
            if self.word(i) == ";":
                return i + 1
            if i >= end or self.t[i].kind != "word":
                return start
            name, k, body = self.word(i), i + 1, None
            if self.word(k) == "(":
                k = self.past(k)
            if self.word(k) == "{":
                body, k = k, self.past(k)
            if self.word(k) not in (",", ";", "}") and k < end:
                return start
            out.append({"what": "enum_constant", "start": start, "end": k - 1, "name": name, "body": body, "annotations": annotations, "modifiers": []})
            i = k + 1 if self.word(k) in (",", ";") else k
            if self.word(k) == ";":
                return i
        return i

    def member(self, i: int, end: int, word: str, type_name: str | None) -> dict[str, Any]:
        head = self.type_head(i)
        if head and head["end"] <= end:
            return {"what": "type", "head": head, "start": i, "end": head["end"]}
        k, annotations, words = self.modifiers(i)
        base: dict[str, Any] = {"start": i, "annotations": annotations, "modifiers": words, "body": None}
        if self.word(k) == "{":
            return base | {"what": "static_initializer" if words == ["static"] else "initializer", "end": self.past(k) - 1, "body": k}
        if self.word(k) == "<":
            k = max(k + 1, self.past_angles(k))
        named = k < len(self.t) and self.t[k].kind == "word"
        if named and self.word(k + 1) == "(" and (self.word(k) == type_name or self.word(k) not in KEYWORDS):
            return self.callable(base, "constructor", k, None, end)
        if named and word == "record" and self.word(k) == type_name and self.word(k + 1) == "{":
            return base | {"what": "constructor", "name": self.word(k), "params": None, "type": None, "throws": [], "body": k + 1, "end": self.past(k + 1) - 1, "compact": True}
        j = self.past_type(k)
        if j > k and j < end and self.t[j].kind == "word" and self.t[j].text not in KEYWORDS:
            if self.word(j + 1) == "(":
                return self.callable(base, "annotation_element" if word == "@interface" else "method", j, (k, j - 1), end)
            last = self.field_end(j, end)
            names = [self.word(x) for x, y in self.parts(j, last) if self.t[x].kind == "word"]
            return base | {"what": "constant" if word in ("interface", "@interface") else "field", "names": names, "type": self.text(k, j - 1), "end": last}
        last = min(max(i, self.past_junk(i) - 1), end - 1)
        return base | {"what": "parse_error", "end": last}

    def field_end(self, j: int, end: int) -> int:
        while j < end and self.word(j) != ";":
            j = self.past(j) if self.word(j) in ("(", "[", "{") else j + 1
        return min(j, end - 1) if j >= end else j

    def callable(self, base: dict[str, Any], what: str, name: int, type_: tuple[int, int] | None, end: int) -> dict[str, Any]:
        params = (name + 1, self.s.match[name + 1])
        k, throws = self.past(name + 1), []
        while k < end and self.word(k) not in ("{", ";", "}"):
            if self.word(k) == "throws":
                stop = k + 1
                while stop < end and self.word(stop) not in ("{", ";"):
                    stop += 1
                throws = [self.text(x, y) for x, y in self.parts(k + 1, stop)]
                k = stop
            elif self.word(k) in ("(", "["):
                k = self.past(k)
            elif self.word(k) == "default":
                while k < end and self.word(k) != ";":
                    k = self.past(k) if self.word(k) in ("(", "[", "{") else k + 1
            else:
                k += 1
        body = k if self.word(k) == "{" else None
        last = self.past(k) - 1 if body is not None else (k if self.word(k) == ";" else k - 1)
        return base | {"what": what, "name": self.word(name), "params": params, "type": self.text(*type_) if type_ else None, "throws": throws, "body": body, "end": last, "compact": False}

    def member_chunks(self, members: list[dict[str, Any]], chain: list[str], own: dict[str, Any] | None, names: list[str], types: list[dict[str, str]]) -> None:
        header = self.header(chain, names)
        for m in members:
            what, a, b = m["what"], m["start"], m["end"]
            if what == "type":
                self.type_(m["head"], chain, own)
                continue
            if what == "parse_error":
                self.emit("parse_error", a, b, chain, own)
                continue
            comment = self.s.comment_before(self.t[a].lo)
            raw = self.text(a, b)
            common = {"embed_text": header + (f"{comment}\n" if comment else "") + raw} | self.commented(comment)
            if what in ("static_initializer", "initializer"):
                self.emit(what if what == "static_initializer" else "instance_initializer", a, b, chain, own, name="<static_init>" if what == "static_initializer" else "<instance_init>", node_type="static_initializer" if what == "static_initializer" else "block", **common)
                continue
            common |= {"annotations": [self.annotation(*r) for r in m["annotations"]], "modifiers": m["modifiers"]}
            if what in ("field", "constant"):
                for name in m["names"]:
                    self.emit(what, a, b, chain, own, name=name, field_type=m["type"], node_type=f"{what}_declaration", **common)
            elif what == "enum_constant":
                self.emit(what, a, b, chain, own, name=m["name"], node_type="enum_constant", **common)
                if m["body"] is not None:
                    self.member_chunks(self.members_between(m["body"] + 1, self.s.match[m["body"]]), [*chain, m["name"]], own, names, types)
            elif what == "annotation_element":
                self.emit(what, a, b, chain, own, name=m["name"], return_type=m["type"], node_type="annotation_type_element_declaration", **common)
            else:
                scope = self.scope(m, types)
                inside = (m["body"] + 1, self.s.match[m["body"]]) if m["body"] is not None else None
                calls = self.calls(*inside) if inside else []
                used = self.fields_used(*inside, names) if inside else []
                node = "compact_constructor_declaration" if m["compact"] else f"{what}_declaration"
                self.emit(what, a, b, chain, own, name=m["name"], node_type=node, return_type=m["type"], parameters=self.text(*m["params"]) if m["params"] else None, throws=m["throws"], calls=calls, fields_accessed=used, symbols=scope, local_types=self.local_types, **common)
                if inside:
                    self.behaviours(*inside, [*chain, m["name"]], own, names, types)

    # --- bodies

    def scope(self, m: dict[str, Any], types: list[dict[str, str]]) -> list[dict[str, str]]:
        """Declared names with their types: fields, then parameters, then what the body declares; later ones win."""
        out = list(types)
        if m["params"]:
            for x, y in self.parts(m["params"][0] + 1, m["params"][1]):
                x = self.modifiers(x)[0]
                if x < y and self.t[y].kind == "word":
                    out.append({"name": self.word(y), "type": self.text(x, y - 1)})
        if m["body"] is not None:
            out += self.declared(m["body"] + 1, self.s.match[m["body"]])
        return list({d["name"]: d for d in out}.values())

    def declared(self, i: int, end: int) -> list[dict[str, str]]:
        out = []
        while i < end:
            head = self.type_head(i) if self.word(i - 1) in ("{", "}", ";") else None
            if head:
                i = head["end"] + 1
                continue
            if self.word(i - 1) in ("{", "}", ";", "(", "->", ":") or self.word(i - 1) == ")":
                k = self.modifiers(i)[0]
                j = self.past_type(k)
                while self.word(j) == "|":  # several types in one catch
                    j = self.past_type(j + 1)
                if j > k and j < end and self.t[j].kind == "word" and self.t[j].text not in KEYWORDS and self.word(j + 1) in ("=", ";", ":", ",", ")", "["):
                    out.append({"name": self.word(j), "type": self.text(k, j - 1)})
                    i = j
            i += 1
        return out

    def calls(self, i: int, end: int) -> list[str]:
        """Call heads in order.  Of a chain only the arguments of the last call are searched."""
        out: list[str] = []
        while i < end:
            t = self.t[i]
            if t.text == "{" and i > 0 and self.word(i - 1) == ")" and (k := self.new_of(i)) is not None:
                i = self.past(i)
                continue
            if t.text == "::" and i + 1 < end:
                out.append(self.text(self.primary_start(i), i + 1))
                i += 2
                continue
            if t.kind == "word" and self.word(i + 1) == "(" and t.text not in KEYWORDS and not self.is_new_type(i) and not self.declares(i):
                names, k = [self.head(i)], i
                while True:
                    close = self.s.match[k + 1]
                    j = close + 2
                    if self.word(close + 1) == "." and j < end:
                        j = max(j, self.past_angles(j))
                        if self.t[j].kind == "word" and self.word(j + 1) == "(":
                            names.append(self.word(j))
                            k = j
                            continue
                    break
                out += names
                out += self.calls(k + 2, self.s.match[k + 1])
                i = self.s.match[k + 1] + 1
                continue
            if t.text in ("this", "super") and self.word(i + 1) == "(":
                out.append("super()")
            i += 1
        return out

    def declares(self, i: int) -> bool:
        """Is the name at i that of a method being declared?"""
        before = self.t[i - 1] if i else None
        return bool(before and before.kind == "word" and (before.text not in KEYWORDS or before.text in PRIMITIVES))

    def is_new_type(self, i: int) -> bool:
        while i > 1 and self.word(i - 1) == "." and self.t[i - 2].kind == "word":
            i -= 2
        return self.word(i - 1) == "new"

    def head(self, i: int) -> str:
        """How the call of the name at i is written: name, receiver.name, or <expr>.name."""
        name = self.word(i)
        if self.word(i - 1) == ">" and "." in (self.word(k) for k in range(max(0, i - 8), i)):
            return f"<expr>.{name}"
        if self.word(i - 1) != ".":
            return name
        before = self.t[i - 2]
        if before.kind == "word" and (before.text not in KEYWORDS or before.text == "this") and self.word(i - 3) not in (".", "::"):
            return f"{before.text}.{name}"
        return f"<expr>.{name}"

    def primary_start(self, i: int) -> int:
        """First token of the expression before the sign at i."""
        k = i - 1
        while k > 0:
            w = self.t[k].text
            if w in (")", "]") and self.s.match[k] >= 0:
                k = self.s.match[k]
                if self.t[k - 1].kind == "word" and self.t[k - 1].text not in KEYWORDS:
                    k -= 1
                    continue
            elif w and set(w) == {">"}:
                depth = len(w)
                while k > 0 and depth > 0:
                    k -= 1
                    depth += self.t[k].text.count(">") * (set(self.t[k].text) == {">"}) - (self.t[k].text == "<")
                k -= 1
                continue
            if self.word(k - 1) == ".":
                k -= 2
                continue
            return k
        return max(k, 0)

    def fields_used(self, i: int, end: int, names: list[str]) -> list[str]:
        known, out = set(names), set()
        for k in range(i, end):
            t = self.t[k]
            if t.kind != "word" or t.text not in known or self.word(k + 1) == "(":
                continue
            if self.word(k - 1) == ".":
                if self.word(k - 2) == "this":
                    out.add(t.text)
            elif self.word(k + 1) != "->" and not (self.t[k - 1].kind == "word" and (self.t[k - 1].text not in KEYWORDS or self.t[k - 1].text in PRIMITIVES)) and self.word(k - 1) != "::":
                out.add(t.text)
        return sorted(out)

    def statement_end(self, i: int, end: int) -> int:
        while i < end and self.word(i) != ";":
            i = self.past(i) if self.word(i) in ("(", "[", "{") else i + 1
        return min(i, end - 1)

    def expression_end(self, i: int, end: int) -> int:
        """Last token of the expression that starts at i."""
        k = i
        while k < end and self.word(k) not in (",", ";", ")", "]", "}"):
            k = self.past(k) if self.word(k) in ("(", "[", "{") else k + 1
        return max(i, min(k, end) - 1)

    def new_of(self, brace: int) -> int | None:
        """Index of ``new`` if the brace at ``brace`` opens an anonymous class body."""
        k = self.s.match[brace - 1] - 1
        while k > 0 and (self.t[k].kind == "word" and self.t[k].text not in KEYWORDS or self.t[k].text in (".", "<", ">", ">>", ">>>", ",", "?", "[", "]", "@", "&", "extends", "super")):
            k -= 1
        return k if self.word(k) == "new" else None

    def behaviours(self, i: int, end: int, owners: list[str], own: dict[str, Any] | None, names: list[str], types: list[dict[str, str]]) -> None:
        header = self.header(owners, names)

        def emit(a: int, b: int, node: str, name: str | None = None, chain: list[str] | None = None) -> None:
            raw = self.text(a, b)
            self.emit("behavior", a, b, owners, own, name=name, node_type=node, embed_text=(self.header(chain, names) if chain else header) + raw)

        refs = {self.primary_start(k): k for k in range(i, end) if self.word(k) == "::"}
        thrown = -1
        while i < end:
            w = self.word(i)
            head = self.type_head(i) if self.word(i - 1) in ("{", "}", ";", ":", "->") else None
            if head and head["end"] < end:
                self.type_(head, owners, own)
                i = head["end"] + 1
                continue
            if i in refs:
                emit(i, min(refs[i] + 1, end - 1), "method_reference")
            if w == "throw":
                emit(i, self.statement_end(i, end), "throw_statement")
                thrown = i + 1
            elif w == "try":
                k = self.past(i + 1) if self.word(i + 1) == "(" else i + 1
                node = "try_with_resources_statement" if k > i + 1 else "try_statement"
                k = self.past(k) if self.word(k) == "{" else k + 1
                while self.word(k) in ("catch", "finally"):
                    k = self.past(k + 1) if self.word(k + 1) == "(" else k + 1
                    k = self.past(k) if self.word(k) == "{" else k + 1
                emit(i, min(k, end) - 1, node)
            elif w == "switch" and self.word(i + 1) == "(":
                k = self.past(i + 1)
                emit(i, min(self.past(k) if self.word(k) == "{" else k, end) - 1, "switch_expression")
            elif w == "(" and self.word(self.past(i)) == "->" or self.t[i].kind == "word" and self.word(i + 1) == "->" and self.word(i - 1) not in ("case", ",", "default") and w not in ("default",) and not self.in_case(i):
                arrow = self.past(i) if w == "(" else i + 1
                if not self.in_case(i):
                    last = self.past(arrow + 1) - 1 if self.word(arrow + 1) == "{" else self.expression_end(arrow + 1, end)
                    emit(i, min(last, end - 1), "lambda_expression")
            elif w == "new":
                k = self.past_type(i + 1)
                if self.word(k) == "(":
                    close = self.s.match[k]
                    if self.word(close + 1) == "{":
                        anon = f"<anon:{self.text(i + 1, k - 1)}>"
                        last = self.s.match[close + 1]
                        emit(i, last, "object_creation_expression", anon, [*owners, anon])
                        self.member_chunks(self.members_between(close + 2, last), [*owners, anon], own, names, types)
                        i = last + 1
                        continue
                    if i != thrown:
                        emit(i, close, "object_creation_expression")
            i += 1

    def in_case(self, i: int) -> bool:
        """Is token i in the label of a case?"""
        k = i - 1
        while k >= 0 and self.word(k) not in ("{", "}", ";", "->"):
            if self.word(k) in ("case", "default"):
                return True
            k -= 1
        return False
