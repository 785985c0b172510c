"""Go call sites at any nesting: generated sources whose sites are known, and malformed brackets."""

import random

import pytest

from estatelens.operators import go_sites as go


def value(rng, depth):
    """An argument that is one value, as text."""
    kinds = ["name", "string", "number", "raw"] if depth <= 0 else ["call", "struct", "func", "slice", "name", "call"]
    kind = rng.choice(kinds)
    if kind == "call":
        return call(rng, depth - 1)[0]
    if kind == "struct":
        return rng.choice(["", "&"]) + "pkg.T{A: " + value(rng, depth - 1) + ", B: " + value(rng, depth - 1) + "}"
    if kind == "func":
        return "func(w W, r *R) { " + call(rng, depth - 1)[0] + "; x := []int{1, 2} }"
    if kind == "slice":
        return "[]T{{" + value(rng, depth - 1) + "}, {" + value(rng, depth - 2) + "}}"
    return {"name": "a.b", "string": '"s(,)}"', "number": "12.5", "raw": "`q\n)(`"}[kind]


def call(rng, depth):
    name = rng.choice(["f", "os.Open", "a.b.C", "g"])
    args = [value(rng, depth) for _ in range(rng.randrange(4))]
    gap = rng.choice([", ", ",", ",\n\t", ", /* c( */ "])
    return f"{name}({gap.join(args)})", name, args


def test_generated_sites(make_files):
    rng = random.Random(5)
    files, want = {}, {}
    for n in range(60):
        text, known = "package p\n\nfunc Run() {\n", []
        for _ in range(rng.randrange(1, 6)):
            body, name, args = call(rng, rng.choice([0, 1, 2, 5]))
            shape = rng.choice(["{}\n", "if x { {} }\n", "y := []T{ {} }\n", "// f(\n{}\n", "s = \"(\" + {}\n"])
            known.append((text.count("\n") + 1 + shape.split("{}")[0].count("\n"), *(name.rpartition(".")[::2]), args))
            text += shape.replace("{}", body)
        files[f"d{n}.go"] = text + "}\n"
        want[f"d{n}.go"] = known
    got = {}
    for r in go.go_call_sites(make_files(files)).filter("kind = 'call'").orderBy("start").collect():
        got.setdefault(r.path, []).append((r.line, r.receiver, r.method, r.args))
    assert got == want


@pytest.mark.parametrize("depth", [7, 8, 9, 30, 400])
def test_depth(make_files, rows_of, depth):
    inner = "w(" * depth + '"x"' + ")" * depth
    sites = go.go_call_sites(make_files({"a.go": f'package a\nimport "net/http"\nfunc F() {{\n\thttp.HandleFunc("/p", {inner})\n\tq.SendMessage(a, b, c, domain.Message{{Body: {inner}, Destination: "D"}})\n}}\n'}))
    assert [(r.method, len(r.args)) for r in sites.filter("kind = 'call'").orderBy("start").collect()] == [("HandleFunc", 2), ("SendMessage", 4)]
    assert sites.filter("method = 'HandleFunc'").first().args[1] == inner
    assert rows_of(go.go_broker_io(sites), "description") == [("activemq message published to D via q.SendMessage() at a.go:5",)]
    assert len(rows_of(go.go_http_io(sites), "description")) == 2


def test_malformed_brackets(make_files):
    text = {
        "unclosed.go": "package a\nfunc F() { g(1; }\nfunc H() { x(2) }\n",
        "crossed.go": "package a\nfunc F() { g(a } b); h(c) }\n",
        "extra.go": "package a\n))) } f(1, 2)\n",
        "marks.go": 'package a\nfunc F() { f("a\x01b", g(\x01)) }\n',
        "empty.go": "",
        "none.go": "package a\n",
    }
    got = {}
    for r in go.go_call_sites(make_files(text)).filter("kind = 'call'").orderBy("start").collect():
        got.setdefault(r.path, []).append((r.method, r.args))
    assert got == {
        "unclosed.go": [("x", ["2"])],
        "crossed.go": [("h", ["c"])],
        "extra.go": [("f", ["1", "2"])],
        "marks.go": [("f", ['"ab"', "g(\x01)"])],
    }


def test_tasks_for_tokens_grow_with_the_texts(make_files, monkeypatch):
    from estatelens.operators import brackets

    files = make_files({f"f{n}.go": "package p\n\nfunc Run() {\n\tos.Open(a, b)\n}\n" for n in range(100)})
    want = sorted(map(str, go.go_call_sites(files).collect()))
    monkeypatch.setattr(brackets, "TASK_TEXT", 100)
    assert brackets._parts(files, "content") >= 40
    assert sorted(map(str, go.go_call_sites(files).collect())) == want and len(want) == 200
