from siltstone.java.chunker import parse


def one(code, **match):
    rows = [c for c in parse(code) if all(c.get(k) == v for k, v in match.items())]
    assert len(rows) == 1, [(c["kind"], c["name"]) for c in parse(code)]
    return rows[0]


def test_comments_belong_to_the_next_member():
    code = b"class X {\n  // first\n  // second\n  @Test\n  void run() { go(); }\n\n  /** Doc. */\n  void doc() { go(); }\n\n  // apart\n\n  void far() { go(); }\n  int a; // behind\n  int b;\n}\n"
    run = one(code, kind="method", name="run")
    assert run["leading_comment"] == "// first\n// second" and run["javadoc"] is None
    own = one(code, kind="skeleton")
    assert run["parent_chunk_id"] == own["chunk_id"] and run["type_span"] == own["span"]
    doc = one(code, kind="method", name="doc")
    assert doc["leading_comment"] == doc["javadoc"] == "/** Doc. */"
    assert one(code, kind="method", name="far")["leading_comment"] is None
    assert one(code, kind="field", name="b")["leading_comment"] is None


def test_places_are_in_bytes():
    m = one("class X {\n    void é() { f(); }\n}\n".encode(), kind="method")
    assert (m["start_line"], m["end_line"], m["start_col"]) == (2, 2, 5)
    assert m["end_col"] == 5 + len("void é() { f(); }".encode())


def test_each_declarator_is_a_field():
    rows = [c for c in parse(b"class Widget {private int a, b;}") if c["kind"] == "field"]
    assert [r["name"] for r in rows] == ["a", "b"] and rows[0]["span"] == rows[1]["span"] == {"lo": 14, "hi": 31} and rows[0]["chunk_id"] != rows[1]["chunk_id"]


def test_modifiers_in_order_without_annotations():
    code = b"@A public abstract class X { @B private static final int N = 1; public synchronized void m() { } void plain() { } }"
    assert one(code, kind="skeleton")["modifiers"] == ["public", "abstract"]
    assert one(code, kind="field")["modifiers"] == ["private", "static", "final"]
    assert one(code, name="m")["modifiers"] == ["public", "synchronized"] and one(code, name="plain")["modifiers"] == []
    assert [a["text"] for a in one(code, kind="field")["annotations"]] == ["@B"]


def test_skeletons():
    text = one(b"package p;\nclass X<T> extends Y implements A, B { int a = 1; X(int q) { } String m(int k) throws E { return null; } }", kind="skeleton")["text"]
    assert text.split("\n") == ["class X <T> extends Y implements A, B", "  int a = 1;", "  X(int q)", "  String m(int k) throws E"]
    assert "constants: RED, GREEN" in one(b"enum C { RED, GREEN; }", kind="skeleton")["text"]
    assert one(b"interface I { void m(); }", kind="skeleton")["text"] == "interface I\n  void m()"
    assert one(b"record P(int x, String y) { }", kind="skeleton")["text"] == "record P (int x, String y)"


def kinds(body):
    return sorted(c["node_type"] for c in parse(b"class X { void f() { " + body + b" } }") if c["kind"] == "behavior")


def test_behaviours():
    assert kinds(b"throw new E();") == ["throw_statement"]
    assert kinds(b"throw new E() { };") == ["object_creation_expression", "throw_statement"]
    assert kinds(b"try { throw new E(); } finally { }") == ["throw_statement", "try_statement"]
    assert kinds(b"try (R r = o()) { run(() -> g()); }") == ["lambda_expression", "try_with_resources_statement"]
    assert kinds(b"try { run(A::b); } catch (E e) { }") == ["method_reference", "try_statement"]
    assert kinds(b"run(x -> switch (x) { case 1 -> 2; default -> 3; });") == ["lambda_expression", "switch_expression"]
    assert kinds(b"switch (x) { case 1: break; default: }") == ["switch_expression"]
    assert kinds(b"Object o = new Object();") == ["object_creation_expression"]
    assert kinds(b"int x = a < b ? 1 : 2;") == []


def test_anonymous_bodies_are_walked_as_members():
    code = b"class X { void fail() { throw new RuntimeException(make()) { public String toString() { return x(); } }; } }"
    anon = one(code, kind="behavior", node_type="object_creation_expression")
    assert anon["name"] == "<anon:RuntimeException>" and anon["owner_chain"] == ["X", "fail"]
    inner = one(code, name="toString")
    assert inner["owner_chain"] == ["X", "fail", "<anon:RuntimeException>"] and inner["kind"] == "method"


def test_calls_and_scope():
    m = one(b"class X { Client c; void f(Order o) { int n = 1; o.ship(g(2)); this.h(); a.b().d(e()); new Q().r(); super.s(); List<String> l = m(); for (Foo q : l) { q.x(); } } }", kind="method")
    assert m["calls"] == ["o.ship", "g", "this.h", "a.b", "d", "e", "<expr>.r", "<expr>.s", "m", "q.x"]
    scope = {s["name"]: s["type"] for s in m["symbols"]}
    assert scope == {"c": "Client", "o": "Order", "n": "int", "l": "List<String>", "q": "Foo"}


def test_initialisers_local_types_constants_and_elements():
    code = b"class X { static { a(() -> 1); } { b(); } void f() { class L { int z; } } @interface A { int v() default 1; } enum E { R { void k() { } } } interface I { int C = 2; } }"
    assert one(code, kind="static_initializer")["name"] == "<static_init>" and one(code, kind="instance_initializer")["name"] == "<instance_init>"
    assert not [c for c in parse(code) if c["kind"] == "behavior"]
    assert one(code, kind="field")["owner_chain"] == ["X", "f", "L"]
    assert one(code, kind="annotation_element")["name"] == "v" and one(code, kind="constant")["name"] == "C"
    assert one(code, name="k")["owner_chain"] == ["X", "E", "R"]


def test_large_types_have_a_skeleton_only():
    code = b"class X { " + b"int field_with_a_long_name = 12345; " * 60 + b"}"
    assert not [c for c in parse(code) if c["kind"] == "type"]


def test_broken_input_never_raises():
    assert "parse_error" in {c["kind"] for c in parse(b"class A { void f( { } } }\n int x; class B { int y")}
    for text in (b"", b"}", b"((((", b"class", b"class {", b"\xff\xfe", b'"', b"/*", b"@", b"class A { @ }", b"enum E { A(", b"x -> y", b"import", b"package a; class B { int f = ; }"):
        assert parse(text)[0]["kind"] == "file"
    code = b"package a; import b.C; class D { void m() { try (X y = z()) { a::b; } catch (E e) { } new F() { int g; }; } }"
    for i in range(len(code)):
        parse(code[:i])
        parse(code[i:])


def test_file_row():
    f = parse(b"package a.b;\nimport c.D;\nimport static e.F.*;\nclass X { }")[0]
    assert (f["package"], f["imports"], f["local_types"]) == ("package a.b;", ["import c.D;", "import static e.F.*;"], ["X"])
    assert parse(b"module m { requires x; }")[0]["module"] == "module m { requires x; }"
