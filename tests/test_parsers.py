"""Front ends and rules on small sources, positive and negative."""

import json

import pytest

from argosec.operators.graph import Flow, reaching_definitions
from argosec.operators.taint import fold_file, sanitizer_regex, source_regex
from argosec.parsers.front import parse_source
from argosec.parsers.tree import COLUMNS
from argosec.plans.scan import Options, sast, scan
from argosec.sources import rules
from argosec.sources.inputs import files_of_rows


def rows(language, text, path="f"):
    return [dict(zip(COLUMNS, r)) for r in parse_source(path, language, text)]


def calls(language, text):
    return [r["callee_text"] for r in rows(language, text) if r["kind"] == "call"]


@pytest.mark.parametrize("language", ["python", "javascript", "typescript", "go", "java", "csharp", "php", "html"])
@pytest.mark.parametrize("text", ["", "   \n\n", "((((", "}}}} ))", "a = ", "\"unclosed", "x" * 5000, "é = 'ü' # 日本\n", "<?php", "/* open", "a.b.c(", "f(" * 300])
def test_no_input_fails(language, text):
    r = rows(language, text)
    assert r[0]["kind"] == "module" and r[0]["parent_ix"] == -1


@pytest.mark.parametrize("language,text", [("python", "def f(a):\n  if a:\n    g(a.b(c), k=1)\n  return a\n"), ("javascript", "const f = (a) => { if (a) { g(a.b(c), {k: 1}); } return a; }"), ("go", "func f(a int) int {\n if a > 0 { g(a.b(c)) }\n return a\n}")])
def test_intervals_are_the_recursive_walk(language, text):
    r = rows(language, text)
    kids = {}
    for x in r:
        kids.setdefault(x["parent_ix"], []).append(x["ix"])

    def below(i):
        return {d for c in kids.get(i, []) for d in {c} | below(c)}

    for x in r:
        assert below(x["ix"]) == set(range(x["ix"] + 1, x["end_ix"] + 1))
        assert [r[c]["child_pos"] for c in kids.get(x["ix"], [])] == list(range(len(kids.get(x["ix"], []))))


def test_callees():
    assert calls("python", "a.b.c(x)\nf()()\nf().g(1)") == ["a.b.c", "", "f", "g", "f"]
    assert calls("java", "class A { void m() { new Foo<Bar>(a.b()); x.y(1); } }") == ["Foo", "a.b", "x.y"]
    assert calls("php", "<?php echo $x; $pdo->query($y); include 'a';") == ["echo", "$pdo", "include"]
    assert calls("csharp", "class A { void M() { var c = new SqlCommand(q, d); string.Format(a); } }") == ["SqlCommand", "string.Format"]
    assert calls("javascript", "new Foo(a); b?.c(d); `t${e(1)}`") == ["Foo", "b.c", "e"]


def test_assignments():
    r = [x for x in rows("go", "func f() {\n\tx, err := g(a)\n\tvar y string = h\n}") if x["kind"] == "assignment"]
    assert [(x["lhs"], x["rhs"]) for x in r] == [("x, err", "g(a)"), ("y", "h")]
    r = [x for x in rows("typescript", "const a: string = req.query.q as string; b += a;") if x["kind"] == "assignment"]
    assert [(x["lhs"], x["augmented"]) for x in r] == [("a", False), ("b", True)]
    r = [x for x in rows("java", 'class A { void m() { String q = r.getParameter("x"); } }') if x["kind"] == "assignment"]
    assert [(x["lhs"], x["rhs"]) for x in r] == [("q", 'r.getParameter("x")')]


def test_except_handlers():
    t = [x for x in rows("python", "try:\n  a()\nexcept:\n  pass\nexcept (A, B) as e:\n  b()\n") if x["kind"] == "try"][0]
    assert t["except_handlers"] == [(True, [], True), (False, ["(A, B)"], False)]
    t = [x for x in rows("javascript", "try { a() } catch (e) { }") if x["kind"] == "try"][0]
    assert t["except_handlers"][0][2]
    assert [x for x in rows("java", "class A { void m() { try { a(); } catch (E e) { } } }") if x["kind"] == "try"][0]["except_handlers"] is None


def test_html_elements_and_scripts():
    page = "<p>\n<A HREF='x' disabled>l</A><script type=\"text/plain\">no()</script>\n<script>var s = 1; go(s)</script><script src=a></script><!-- <b> -->"
    r = rows("html", page, "p.html")
    assert [x["callee_text"] for x in r if x["kind"] == "call" and x["language"] == "html"] == ["p", "a", "script", "script", "script"]
    js = [x for x in r if x["language"] == "javascript"]
    assert js[0]["path"] == "p.html#script0"
    assert [(x["callee_text"], x["start_line"], x["start_col"]) for x in js if x["kind"] == "call"] == [("go", 3, 19)]
    assert [(x["kwarg_name"], x["kwarg_value"]) for x in r if x["kind"] == "keyword_argument"][:2] == [("href", "x"), ("disabled", "")]


def test_bad_lines_are_left_out():
    r = rows("python", "eval(x)\nthis is no python\nexec(y)\n")
    assert [x["callee_text"] for x in r if x["kind"] == "call"] == ["eval", "exec"] and r[0]["warning"]


def test_rules_match_and_clean_sources_do_not(spark):
    data = [("a.py", "x = 1\nassert x\neval(x)\n"), ("b.py", "y = shlex.quote(request.args['a'])\nsubprocess.call(y)\n"), ("c.py", "y = request.args['a']\nsubprocess.call(y)\n"), ("d.html", "<a target=_blank rel=noopener href=x>l</a>"), ("e.html", "<a target=_blank href=x>l</a><script>eval(location.hash)</script>"), ("f.py", "y = request.args['a']\ny = 1\nsubprocess.call(y)\n"), ("g.py", "y = request.args['a']\ny += 1\nsubprocess.call(y)\n")]
    f = files_of_rows(spark.createDataFrame(data, "path string, content string"))
    found = {}
    for r in sast(f, rules.load_rules(spark)).collect():
        found.setdefault(r.file, []).append((r.rule_id, r.start_line))
    assert sorted(found["a.py"]) == [("ZS-PY-001", 3), ("ZS-PY-009", 2)]
    assert "b.py" not in found and "f.py" not in found and "d.html" not in found
    assert ("ZS-PY-012", 2) in found["c.py"] and ("ZS-PY-012", 3) in found["g.py"]
    assert ("ZS-HTML-001", 1) in found["e.html"] and ("ZS-JS-001", 1) in found["e.html"]


@pytest.mark.parametrize("graphs", [False, True])
def test_facts_of_one_stage_are_those_of_the_joins(spark, graphs):
    from argosec.parsers.front import ir_nodes
    from argosec.plans import catalogue

    data = [(f"t{i}.{t[0]}", t[1]) for i, t in enumerate(catalogue._TEMPLATES.values())] + [("g.py", "def g(p):\n  def h():\n    return request.args\n  return p\nw = h()\nz = g(w)\nos.popen(z)\nz += 1\n"), ("e.html", "<p>\n<script>\nfunction f(){ return location.hash }\nvar s = f();\neval(s)</script>")]
    f = files_of_rows(spark.createDataFrame(data, "path string, content string"))
    r = rules.load_rules(spark)
    one, joined = (sorted(map(str, sast(f, r, graphs, n).collect())) for n in (None, ir_nodes(f)))
    assert len(one) > 30 and one == joined


def test_fingerprint_survives_moved_lines(spark):
    text = "def f(a):\n    eval(a)\n"
    f = files_of_rows(spark.createDataFrame([("a.py", text), ("b.py", "\n\n# more\n" + text)], "path string, content string"))
    rows_ = sast(f, rules.load_rules(spark)).collect()
    assert len({r.fingerprint for r in rows_}) == 1 and len(rows_) == 2


def test_taint_paths_with_graphs(spark):
    f = files_of_rows(spark.createDataFrame([("a.py", "x = request.args['q']\ny = x\nos.popen(y)\n")], "path string, content string"))
    r = [x for x in sast(f, rules.load_rules(spark), graphs=True).collect() if x.taint][0]
    assert [tuple(p) for p in r.taint.path] == [(1, 0), (2, 0)] and r.taint.source_expr == "propagated from x"


def test_scan_of_nothing(spark):
    f = files_of_rows(spark.createDataFrame([], "path string, content string"))
    assert scan(spark, f, Options(secrets=True, config=True)).count() == 0


def test_fold():
    def a(ix, lhs, rhs, names=(), aug=False, call=None, call_names=()):
        return dict(ix=ix, lhs=lhs, rhs=rhs, names=list(names), augmented=aug, call=call, call_names=list(call_names), line=ix, col=0)

    src, san = source_regex("python"), sanitizer_regex("python")
    out = {o["var"]: o["tainted"] for o in fold_file([a(1, "x", "request.args"), a(2, "y", "f(x)", ["f"], call="f", call_names=["x"]), a(3, "z", "html.escape(x)", ["html", "escape", "x"]), a(4, "x", "1")], src, san, {"f": (False, True)})}
    assert out == {"x": False, "y": True, "z": False}


def test_reaching_definitions_join_branches():
    n = rows("python", "x = 1\nif a:\n    x = 2\nelse:\n    b()\ny = x\nwhile c:\n    y = 3\nz = y\n")
    ins = reaching_definitions(n)
    line = {x["ix"]: x["start_line"] for x in n}
    at = {x["lhs"] + str(x["start_line"]): x["ix"] for x in n if x["kind"] == "assignment"}
    assert {line[d] for d in ins[at["y6"]]["x"]} == {1, 3}
    assert {line[d] for d in ins[at["z9"]]["y"]} == {6, 8}
    assert ("loop-back") in {k for *_, k in Flow(n).edges}


def test_catalogue():
    every = rules.shipped()
    assert len(every) == 272 and not [e for r in every for e in rules.validate(r)]
    assert json.dumps(every)


def test_validation():
    assert rules.validate({"id": "a", "name": "b", "language": "python", "kind": "call"}) == ["a call rule needs a callee or filters"]
    assert rules.validate({"id": "a", "name": "b", "language": "python", "kind": "call", "callee": "x", "suffix": True}) == ["a suffix callee needs a dot"]
    assert rules.validate({"id": "a", "name": "b", "language": "cobol", "kind": "defer"}) == ["unknown kind defer", "unknown language cobol"]


def test_negated_patterns(spark, tmp_path):
    head = "name: n\nlanguage: python\nseverity: low\nconfidence: low\ncategory: c\nmatch:\n  kind: {k}\n  callee: run\n  filters:\n"
    (tmp_path / "a.yaml").write_text("id: U-1\n" + head.format(k="call") + "    - not: {kind: call, filters: [{argument_count: 2}]}\n")
    (tmp_path / "b.yaml").write_text("id: U-2\n" + head.format(k="call") + "    - not: {kind: call, filters: [{not: {kind: call, filters: [{argument_literal_matches: '^x'}]}}]}\n")
    (tmp_path / "c.yaml").write_text("id: U-3\nname: n\nlanguage: python\nmatch:\n  kind: assignment\n  filters:\n    - not: {kind: assignment, lhs_identifier: '^_'}\n")
    f = files_of_rows(spark.createDataFrame([("a.py", "run('x')\nrun('y', 1)\nrun('x', 2)\n_a = 1\nb = 2\n")], "path string, content string"))
    assert sorted((r.rule_id, r.start_line) for r in sast(f, rules.load_rules(spark, str(tmp_path))).collect()) == [("U-1", 1), ("U-2", 1), ("U-2", 3), ("U-3", 5)]
    for bad in ("{kind: call, filters: [{nonsense: 1}]}", "{callee: run}", "{kind: call, other: 1}", "{kind: call, filters: [{not: {kind: call, filters: [{not: {kind: call}}]}}]}"):
        (tmp_path / "a.yaml").write_text("id: U-1\n" + head.format(k="call") + f"    - not: {bad}\n")
        with pytest.raises(rules.RuleError):
            rules.load_rules(spark, str(tmp_path))


def test_texts_of_the_catalogue(spark):
    every = rules.shipped()
    assert all(r["message"] and r["rationale"] and r["fix_suggestion"] and r["owasp"] and r["tags"] and (r["references"] if r.get("cwe") else True) for r in every)
    assert rules.by_tag(rules.load_rules(spark), "ssrf").count() == 19


def test_user_rules(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("id: U-1\nname: mine\nlanguage: python\nseverity: low\nconfidence: low\ncategory: c\nmatch:\n  kind: call\n  callee: conn.run\n  callee_suffix: true\n  filters:\n    - argument_literal_matches: '^drop'\n")
    f = files_of_rows(spark.createDataFrame([("a.py", "db.conn.run('drop t')\nXconn.run('drop t')\nconn.run('keep')\n")], "path string, content string"))
    assert [(r.rule_id, r.start_line) for r in sast(f, rules.load_rules(spark, str(tmp_path))).collect()] == [("U-1", 1)]
    (tmp_path / "s.yaml").write_text("id: U-2\nname: bad\nlanguage: python\nmatch: {kind: call}\n")
    with pytest.raises(rules.RuleError):
        rules.load_rules(spark, str(tmp_path))
