"""Sources, findings, reports, state, streaming, command line."""

import json
import os
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from argosec import cli
from argosec.functions.text import entropy, glob_regex
from argosec.operators import accuracy, dependencies, findings, incremental, intervals, matching, reports, secrets, symbols
from argosec.plans import scan as scan_plan
from argosec.plans.scan import Options, scan
from argosec.sources import config_kv, inputs, lockfiles, rules, walk
from argosec.sources import http as http_client
from argosec.sources.inputs import files_of_rows
from argosec.streaming.scan import stream_secrets


def files(spark, **named):
    return files_of_rows(spark.createDataFrame([(k, v) for k, v in named.items()] or [], "path string, content string"))


@pytest.mark.parametrize("glob,path,hit", [("*.py", "a.py", True), ("*.py", "d/a.py", False), ("a?c", "abc", True), ("[!a]b", "cb", True), ("a.b", "axb", False)])
def test_glob(glob, path, hit):
    import re

    assert bool(re.search(glob_regex(glob).replace(r"\z", r"\Z"), path)) == hit


@pytest.mark.parametrize("glob,path,hit", [("**/x.py", "x.py", True), ("**/x.py", "a/b/x.py", True), ("a/**", "a/b/c", True), ("{a,b}.py", "b.py", True), ("{a,b}.py", "c.py", False)])
def test_glob_double_star(glob, path, hit):
    import re

    assert bool(re.search(glob_regex(glob, True).replace(r"\z", r"\Z"), path)) == hit


def test_entropy(spark):
    df = spark.createDataFrame([("aabb",), ("abcdefgh",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(entropy(F.col("s"))).collect()] == [1.0, 3.0, 0.0, None]


def test_walk(spark, tmp_path):
    for name, body in {"a.py": b"x", "node_modules/b.py": b"x", "sub/c.JS": b"x", "sub/d.min.js": b"x", "e.png": b"x", "big.py": b"x" * (1 << 20), "bigger.py": b"x" * ((1 << 20) + 1), "bin.dat": b"a\x00b", "tool": b"#!/usr/bin/env node\n", "gone/f.go": b"x", "g.txt": b"\x10\x00"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(body)
    (tmp_path / ".gitignore").write_text("# c\ngone/\n*.txt\n")
    got = {r.rel_path: (r.language, r.is_binary) for r in walk.walk(spark, str(tmp_path)).collect() if not r.rel_path.startswith(".")}
    assert got == {"a.py": ("python", False), "sub/c.JS": ("javascript", False), "big.py": ("python", False), "bin.dat": ("unknown", True), "tool": ("javascript", False)}


def test_walk_survives_any_bytes_and_scopes_ignore_files(spark, tmp_path):
    tree = {"a/keep.py": b"x = '\xe9'\n", "a/wide.py": "x = 1".encode("utf-16"), "a/__init__.py": b"", "a/.env": b"DEBUG=true\n", "a/sub/t.py": b"x", "a/sub/t.go": b"x", "a/sub/deep/u.py": b"x", "b/sub2/t.py": b"x", "node_modules/x/.gitignore": b"*.go\n", "node_modules/x/y.go": b"x", "c/t.go": b"x", "_under/z.py": b"x", "a/[b].py": b"x"}
    tree |= {"a/sub/.gitignore": b"*.py\n!keep\n# c\n[z-a]\n", ".zsignore": b"gone/\nb/sub2/*.js\n", "gone/w.py": b"x", "b/gone/w.py": b"x", "b/sub2/v.js": b"x"}
    for name, body in tree.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_bytes(body)
    (tmp_path / "loop").symlink_to(tmp_path)
    got = {r.rel_path: r for r in walk.walk(spark, str(tmp_path)).collect()}
    assert set(got) == set(tree) - {"a/sub/t.py", "a/sub/deep/u.py", "node_modules/x/.gitignore", "node_modules/x/y.go", "gone/w.py", "b/sub2/v.js"}
    assert got["a/keep.py"].content == "x = '\ufffd'\n" and got["a/keep.py"].language == "python" and got["a/wide.py"].is_binary and got["a/__init__.py"].size == 0
    assert {r.rule_id for r in scan(spark, walk.walk(spark, str(tmp_path)), Options(config=True)).collect()} == {"ZS-CFG-001"}


def test_large_trees_are_listed_in_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "LIST_STEP", 3)
    for i in range(6):
        for j in range(3):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "f.py").write_text("x")
    found = walk.listing(spark, str(tmp_path)).where("kind = 'file'").collect()
    assert len(found) == 18 and len({r.rel_path for r in found}) == 18


def test_state_falls_back_when_its_files_are_gone(spark, tmp_path):
    state = incremental.State(spark, str(tmp_path / "s"))
    f = files(spark, **{"a.py": "eval(x)\n"})
    want = [(r.file, r.rule_id) for r in scan(spark, f, Options(), state=state).collect()]
    names = state.read()
    for p in (tmp_path / "s" / names["findings"]).glob("*.parquet"):
        p.unlink()
    with pytest.warns(UserWarning, match="every file is scanned"):
        assert [(r.file, r.rule_id) for r in scan(spark, f, Options(), state=state).collect()] == want
    for k in range(3):
        state.replace({"findings": f}, scan_plan.meta(Options()))
    assert len(list((tmp_path / "s").glob("findings-*"))) == 2


def test_own_scanner(spark, monkeypatch):
    monkeypatch.setattr(scan_plan, "SCANNERS", list(scan_plan.SCANNERS))
    scan_plan.register(lambda o: True, lambda i: i.files.where("path = 'a.py'").select(F.lit("U-1").alias("rule_id"), F.col("path").alias("file"), F.lit("own").alias("kind"), F.lit(1).alias("start_line"), F.lit(0).alias("start_col")))
    assert {r.rule_id for r in scan(spark, files(spark, **{"a.py": "x = 1\n", "b.py": "x = 2\n"}), Options()).collect()} == {"U-1"}


def test_secrets(spark):
    f = files(spark, a="id AKIA" + "A1" * 8 + "\npassword = 'aaaaaaaaaaaa'\npassword = 'p4x-Zq91!k'\n-----BEGIN PRIVATE KEY-----\nAKIA" + "A1" * 8 + " AKIA" + "B2" * 8)
    rows = secrets.secrets(f).collect()
    assert sorted((r.rule_id, r.line_no) for r in rows) == [("ZS-SEC-001", 1), ("ZS-SEC-001", 5), ("ZS-SEC-004", 3), ("ZS-SEC-005", 4)]
    assert all("p4x-Zq91" not in str(r) for r in rows)


def test_env_and_yaml(spark):
    e = config_kv.env_entries(files(spark, x="# c\nexport A='b c'\nB = \"d\"\nC\nD=e=f\r\n"))
    assert [(r.key, r.value, r.line) for r in e.orderBy("line").collect()] == [("A", "b c", 2), ("B", "d", 3), ("D", "e=f", 5)]
    assert config_kv.flatten_yaml("a: &x {b: 1}\nc: [*x, 2]\n---\nz: 1") == [("a.b", "1", 1), ("c.1", "2", 2)]
    assert config_kv.flatten_yaml(": : [") == []


def test_lockfiles(spark):
    yarn = '# v1\n\n"@s/a@^1", "@s/a@^2":\n  version "1.2.3"\n  dependencies:\n    version "9"\n\n__metadata:\n  version: 6\n\nb@npm:^3:\n  version: 3.0.0\n'
    f = files_of_rows(spark.createDataFrame([("yarn.lock", yarn), ("pnpm-lock.yaml", "packages:\n  /a@1.0.0: {}\n  '@s/b@2.0.0(x@1)': {}\n"), ("x/package-lock.json", "not json"), ("Pipfile.lock", "{}"), ("pom.xml", "<bad")], "path string, content string"))
    got = {(r.package, r.version) for r in lockfiles.dependencies(f).collect()}
    assert {("@s/a", "1.2.3"), ("b", "3.0.0"), ("@s/b", "2.0.0")} <= got
    assert ("a", "1.0.0") in got and not [g for g in got if g[0] == "__metadata"]


def test_versions(spark):
    df = spark.createDataFrame([("1.10.0", "1.9"), ("v2", "2.0.0"), ("1.0-rc1", "1.0.0")], "a string, b string")
    r = df.select((dependencies.version_key(F.col("a")) > dependencies.version_key(F.col("b"))).alias("gt"), (dependencies.version_key(F.col("a")) == dependencies.version_key(F.col("b"))).alias("eq")).collect()
    assert [(x.gt, x.eq) for x in r] == [(True, False), (False, True), (False, True)]


def _found(spark):
    f = files(spark, **{"a.py": "eval(x)\nq = request.args['a']\nos.popen(q)\nsubprocess.call(q)\n", "b.js": "eval(location.hash)\n", "c.env": "DEBUG=true\n"})
    return scan(spark, f, Options(secrets=True, config=True))


def test_reports(spark):
    found = _found(spark).cache()
    doc = json.loads(reports.json_report(found, "severity"))
    assert [g["key"] for g in doc["groups"]][0] in ("critical", "high") and doc["stats"]["by_kind"]["config"] == 1
    assert len(json.loads(reports.json_report(found))["findings"]) == found.count()
    s = json.loads(reports.sarif(found))
    run = s["runs"][0]
    assert len(run["results"]) == found.count()
    assert all(run["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for r in run["results"])
    assert all(r["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1 for r in run["results"])
    page = reports.html_report(found, "rule", datetime(2024, 5, 6, 7, 8, 9))
    assert "ZS-PY-001" in page and "Generated 2024-05-06 07:08:09 UTC" in page and page.count("<tr>") == found.count()
    rule = next(r for r in run["tool"]["driver"]["rules"] if r["id"] == "ZS-PY-001")
    assert rule["fullDescription"]["text"] and "Remediation: " in rule["help"]["text"] and rule["helpUri"] == "https://cwe.mitre.org/data/definitions/95.html" and rule["properties"]["tags"] == ["external/cwe/cwe-95", "external/owasp/a03-2021"]
    for by in ("file", "rule", "severity", "language"):
        doc = json.loads(reports.json_report(found, by))
        field = {"file": "file", "rule": "rule_id"}.get(by, by)
        assert sum(len(g["findings"]) for g in doc["groups"]) == found.count() and all(f[field] == g["key"] for g in doc["groups"] for f in g["findings"])
    assert json.loads(reports.json_report(found.limit(0), "rule"))["groups"] == [] and json.loads(reports.json_report(found.limit(0)))["findings"] == []
    chains = [r.metadata for r in found.collect() if r.metadata]
    assert len(chains) == 2 and chains[0]["chain_size"] == "2"
    found.unpersist()


def test_dedup_is_idempotent(spark):
    found = _found(spark)
    once = findings.dedup(found)
    assert once.count() == findings.dedup(once.unionByName(once)).count()


def test_allowlist(spark, tmp_path):
    p = tmp_path / "allow.yaml"
    p.write_text("version: 1\nsuppressions:\n  - id: ZS-PY-001\n  - id: ZS-JS-001\n    path: '*.js'\n")
    kept, gone = findings.suppressed(_found(spark), findings.allowlist(spark, inputs.load_allowlist(str(p))))
    assert {r.rule_id for r in gone.collect()} == {"ZS-PY-001", "ZS-JS-001"} and kept.count() > 0
    assert inputs.load_allowlist(str(tmp_path / "none.yaml")) == []
    with pytest.raises(FileNotFoundError):
        inputs.load_allowlist(str(tmp_path / "none.yaml"), True)


def test_accuracy(spark):
    f = spark.createDataFrame([("a", "R1", "sast"), ("a", "R2", "sast"), ("b", "R1", "sast"), ("z", "R1", "sast")], "file string, rule_id string, kind string").withColumn("dependency", F.lit(None).cast("struct<ecosystem:string,package:string>"))
    cases = spark.createDataFrame([("a", "python"), ("b", "go")], "file string, language string")
    e = spark.createDataFrame([("a", "python", "sast", "R1", 1, None, None), ("b", "go", "sast", "R1", 2, None, None)], accuracy.EXPECTATION)
    r = accuracy.gate(accuracy.score(f, cases, e)).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.passed) == (1, 1, 1, 0.5, 0.5, False)
    empty = accuracy.summary(accuracy.score(f.limit(0), cases.limit(0), e.limit(0))).first()
    assert (empty.precision, empty.recall) == (1.0, 1.0)


META = {"format": 1, "engine": 1, "rules": "a", "options": "", "ir_schema": 1}


@pytest.mark.parametrize("field,drop", [("format", ("findings", "nodes")), ("engine", ("findings", "nodes")), ("rules", ("findings",)), ("ir_schema", ("nodes",)), ("options", ("findings",))])
def test_invalidation(field, drop):
    assert incremental.invalid(META, META) == ()
    assert incremental.invalid(META, META | {field: "other"}) == drop
    assert incremental.invalid(None, META) == ("findings", "nodes")


def test_incremental_is_full(spark, tmp_path):
    state = incremental.State(spark, str(tmp_path / "s"))
    one = files(spark, a="x AKIA" + "A1" * 8, b="nothing")
    two = files(spark, a="x AKIA" + "A1" * 8, b="now AKIA" + "B2" * 8)
    seen = []

    def compute(f):
        seen.append(sorted(r.path for r in f.collect()))
        return secrets.secrets(f)

    state.replace({"findings": incremental.refresh(one, state.table("findings", META), compute)}, META)
    got = incremental.refresh(two, state.table("findings", META), compute)
    assert {(r.path, r.rule_id) for r in got.collect()} == {(r.path, r.rule_id) for r in secrets.secrets(two).collect()}
    assert seen[0] == ["a", "b"] and "a" not in seen[1]
    assert state.table("findings", META | {"rules": "b"}) is None
    (tmp_path / "s" / "current.json").write_text("{broken")
    assert state.table("findings", META) is None


def test_incremental_scan(spark, tmp_path):
    state = incremental.State(spark, str(tmp_path / "s"))
    one = files(spark, **{"a.py": "eval(x)\n", "b.py": "y = 1\n", "c.html": "<script>eval(location.hash)</script>"})
    two = files(spark, **{"a.py": "eval(x)\n", "b.py": "exec(y)\n", "c.html": "<script>eval(location.hash)</script>"})
    for f in (one, one, two):
        got = sorted((r.file, r.rule_id, r.start_line, r.fingerprint) for r in scan(spark, f, Options(), state=state).collect())
        assert got == sorted((r.file, r.rule_id, r.start_line, r.fingerprint) for r in scan(spark, f, Options()).collect())
    assert {r.path for r in incremental.misses(two, state.table("findings", scan_plan.meta(Options()))).collect()} == set()
    assert state.table("findings", scan_plan.meta(Options(graphs=True))) is None


@pytest.fixture
def server():
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def reply(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            seen.append((self.command, self.path, body, dict(self.headers)))
            status, out = 200, {}
            if self.path == "/v1/querybatch":
                if sum(s[1] == self.path for s in seen) == 1:
                    status = 503
                out = {"results": [{"vulns": [{"id": "A-1"}, {"id": "A-2"}]} if q["package"]["name"] == "bad" else {} for q in json.loads(body)["queries"]]}
            elif self.path == "/v1/vulns/A-1":
                out = {"id": "A-1", "database_specific": {"severity": "MODERATE"}, "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "2.0"}]}]}]}
            elif self.path == "/v1/vulns/A-2":
                status = 404
            elif self.path == "/api/v1/scans":
                status, out = (401, {}) if "good" not in self.headers["Authorization"] else (201, {"scan_id": "7"})
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        do_GET = do_POST = do_PUT = reply

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", seen
    s.shutdown()


def test_advisory_service(spark, server):
    url, seen = server
    deps = spark.createDataFrame([("PyPI", "bad", "1.0", "r.txt", True), ("PyPI", "fine", "1.0", "r.txt", True)], lockfiles.DEPENDENCY).coalesce(1)
    r = http_client.vulnerable(deps, url, pause=0.01).collect()
    assert [(x.package, x.advisory_ids, x.vulnerable_range, x.severity, x.confidence) for x in r] == [("bad", ["A-1"], ">=0, <2.0", "medium", "high")]
    assert [s[1] for s in seen][:2] == ["/v1/querybatch"] * 2


def test_portal(server, tmp_path):
    url, seen = server
    p = tmp_path / "r.json"
    p.write_text('{"findings": []}')
    assert cli.main(["upload", "--report", str(p), "--html", str(p), "--server", url, "--token", "good"]) == 0
    assert [s[1] for s in seen] == ["/api/v1/scans", "/api/v1/scans/7/upload/json", "/api/v1/scans/7/upload/html"] and seen[1][2] == p.read_bytes() and p.read_bytes() in seen[2][2]
    assert cli.main(["upload", "--report", str(p), "--server", url, "--token", "bad"]) == 2
    http_client.Portal(url, "good").set_status("7", "failed", "x")
    assert json.loads(seen[-1][2]) == {"status": "failed", "error_message": "x"}


def test_stream_is_batch(spark, tmp_path):
    rows = [("a", "AKIA" + "A1" * 8), ("b", "AKIA" + "B2" * 8)]
    spark.createDataFrame(rows, "path string, content string").write.json(str(tmp_path / "in"))
    q = stream_secrets(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b"}


def test_rule_hash_ignores_line_ends(spark, tmp_path):
    (tmp_path / "a.yaml").write_bytes(b"id: 1\r\n")
    (tmp_path / "b.yaml").write_bytes(b"id: 2\n")
    df = spark.createDataFrame([("b.yaml", "id: 2\n"), ("a.yaml", "id: 1\n")], "path string, content string")
    assert rules.rule_set_hash(df).first().hash == rules.local_hash(str(tmp_path))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.py").write_text("eval(x)\n")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "b.js").write_text("eval(x)\n")
    out = tmp_path / "r.json"
    assert cli.main(["scan", str(tmp_path), "--lang", "python", "--output", str(out)]) == 1
    assert {f["rule_id"] for f in json.loads(out.read_text())["findings"]} == {"ZS-PY-001"}
    with pytest.raises(SystemExit):
        cli.main(["scan", str(tmp_path), "--lang", "cobol"])
    corpus = tmp_path / "corpus" / "python"
    corpus.mkdir(parents=True)
    (corpus / "v.py").write_text("eval(x)\n")
    (corpus / "c.py").write_text("x = 1\n")
    (corpus / "manifest.yaml").write_text("version: '1'\ncases:\n  - file: v.py\n    expect: [{rule_id: ZS-PY-001}]\n  - file: c.py\n    expect: []\n")
    assert cli.main(["bench", "--corpus", str(tmp_path / "corpus"), "--md-out", str(tmp_path / "m.md")]) == 0
    assert "TP 1, FP 0, FN 0" in (tmp_path / "m.md").read_text()


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="abc=(){};.,'\"\n \\/*<>$:", max_size=80), st.sampled_from(["python", "javascript", "go", "java", "csharp", "php", "html", "typescript"]))
def test_any_text_parses(text, language):
    from argosec.parsers.front import parse_source

    r = parse_source("p", language, text)
    assert r[0][2] == 0 and all(x[2] <= x[3] for x in r)


def test_no_llm_import_outside():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "argosec")
    for folder, _, names in os.walk(root):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "argosec.llm" not in f.read(), n


def test_rules_over_literal_columns_are_planned_at_once(spark):
    """Nodes with literal and null columns gave the optimizer constraints until its heap was full."""
    from concurrent.futures import ThreadPoolExecutor

    args = F.array(F.struct(*(F.col("path").alias(c) for c in ("kind", "text", "source", "kwarg_name", "kwarg_value"))))
    none = {"text": "string", "lhs": "string", "rhs": "string", "attribute_texts": "array<string>", "except_handlers": "array<struct<is_bare:boolean,types:array<string>,is_empty_body:boolean>>"}
    n = spark.createDataFrame([("a.py",)], "path string").select("path", F.lit("python").alias("language"), F.lit(0).alias("ix"), F.lit("call").alias("kind"), F.lit("eval").alias("callee_text"), F.lit("eval").alias("callee_last"), F.lit(1).alias("argument_count"), args.alias("args"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    taint = n.select("path", F.lit("v").alias("var"), F.lit(True).alias("tainted"))
    pool = ThreadPoolExecutor(1)
    try:
        found = pool.submit(lambda: matching.match(n, rules.load_rules(spark), taint).select("path", F.col("rule.id").alias("id")).collect()).result(timeout=90)
    finally:
        pool.shutdown(wait=False)
    assert ("a.py", "ZS-PY-001") in [tuple(r) for r in found]


def test_ancestors_meet_by_blocks(spark):
    import random

    rng, rows = random.Random(4), []

    def grow(path, up):
        ix = len(rows)
        rows.append([path, ix, ix, up])
        for _ in range(rng.choice((0, 0, 0, 1, 2)) if up >= 0 else 60):
            grow(path, ix)
        rows[ix][2] = len(rows) - 1

    grow("a", -1)
    grow("b", -1)  # places of the second file begin somewhere
    t = spark.createDataFrame([tuple(r) for r in rows], "path string, ix int, end_ix int, parent_ix int")
    want, up = set(), {r[1]: r[3] for r in rows}
    for path, ix, _, at in rows:
        d = 0
        while at >= 0:
            d += 1
            want.add((path, ix, at, d))
            at = up[at]
    got = intervals.ancestors(t, t)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(rows) > 2 * intervals.BLOCK
    below = intervals.descendants(t, t.where("ix % 3 = 0"))
    assert sorted(tuple(r) for r in below.collect()) == sorted((p, a, i) for p, i, a, _ in want if a % 3 == 0)
    assert "block" in got._jdf.queryExecution().optimizedPlan().toString()  # by path alone a file's nodes would all be held against each other


def test_resolve_writes_no_chains(spark):
    import random

    rng, limit = random.Random(6), "spark.sql.cteRecursionRowLimit"
    scopes_ = [(p, i, rng.randrange(max(0, i - 3), i) if i else None) for p in "ab" for i in range(60)]
    syms = [(p, rng.choice("xyz"), i + 1, rng.randrange(60), rng.choice(("class", "function"))) for p in "ab" for i in range(25)]
    names = [(p, rng.choice("xyzw"), rng.randrange(70)) for p in "abc" for _ in range(80)]
    up = {(p, i): u for p, i, u in scopes_}
    chains, want = set(), set()
    for p, i, _ in scopes_:
        at, d = i, 0
        while at is not None:
            chains.add((p, i, at, d))
            at, d = up[p, at], d + 1
    for p, n, i in names:
        found = min(((d, s[2], s[4]) for q, j, at, d in chains if (q, j) == (p, i) for s in syms if (s[0], s[1], s[3]) == (p, n, at)), default=None)
        if found:
            want.add((p, n, i, *found[1:]))
    sc = spark.createDataFrame(scopes_, "path string, scope_ix int, parent_ix int")
    before = spark.conf.get(limit)
    spark.conf.set(limit, 200)
    try:
        got = symbols.resolve(spark.createDataFrame(names, "path string, name string, scope_ix int"), spark.createDataFrame(syms, "path string, name string, seq int, scope_ix int, kind string"), sc)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(chains) > 400
        assert sorted(tuple(r) for r in symbols.scope_chains(sc).collect()) == sorted(chains)
    finally:
        spark.conf.set(limit, before)
    assert [t for _, t in got.dtypes] == ["string", "string", "int", "int", "string"]


def test_lines_are_summed_up_without_a_sort(spark):
    import random

    rng = random.Random(9)
    rows = [(rng.choice("ab"), i + 1, rng.choice("fg"), rng.choice(("class", "function", "variable")), a := rng.randrange(20), a + rng.randrange(9)) for i in range(90)]
    s = spark.createDataFrame(rows, "path string, seq int, name string, kind string, start_line int, end_line int")
    at = spark.createDataFrame([(p, n) for p in "abc" for n in range(-1, 30)] * 2, "path string, line int")
    scope = symbols.scope_at(at, s.withColumn("scope_ix", F.col("seq")))
    held = {(p, n): [r for r in rows if r[0] == p and r[4] <= n <= r[5]] for p in "abc" for n in range(-1, 30)}
    assert {(r.path, r.line): r.scope_ix for r in scope.collect()} == {k: min(((r[5] - r[4], r[1]) for r in v), default=(0, 0))[1] for k, v in held.items()}
    named = symbols.enclosing_symbol(at, s).collect()
    assert {(r.path, r.line): r.symbol for r in named} == {k: min(((r[1], r[2]) for r in v if r[3] != "variable"), default=(0, ""))[1] for k, v in held.items()} and len(named) == len(held)
    assert "SortAggregate" not in scope._jdf.queryExecution().sparkPlan().toString() and dict(scope.dtypes)["scope_ix"] == "int"


@pytest.mark.parametrize("read,path,text", [(lockfiles.pnpm, "pnpm-lock.yaml", "packages:\n  /a@1.0: {}\n"), (lockfiles.maven, "pom.xml", "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency></dependencies></project>")])
def test_manifests_of_one_split_are_read_by_all_tasks(spark, read, path, text):
    f = spark.range(40).coalesce(1).select(F.concat(F.col("id").cast("string"), F.lit(f"/{path}")).alias("path"), F.lit(text).alias("content"))
    got = read(f)
    assert got.count() == 40 and "Exchange" in got._jdf.queryExecution().executedPlan().toString()


def test_line_counts_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(walk, "FILES_A_TASK", 5)
    f = spark.createDataFrame([(f"p{i % 30}", f"same\nsame\nl{i % 7}\n" if i != 3 else None) for i in range(40)], "path string, content string")
    got = walk.line_counts(f)
    want = {}
    for i in range(40):
        for x in ("same", "same", f"l{i % 7}", "") if i != 3 else ():
            n, paths = want.get(x, (0, frozenset()))
            want[x] = n + 1, paths | {i % 30}
    assert {r.line: (r.n, r.n_files) for r in got.collect()} == {k: (n, len(p)) for k, (n, p) in want.items()}
    assert "hashpartitioning(path" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "), REPARTITION_BY_NUM" in plan and ", 8), REPARTITION_BY_NUM" in plan


def test_files_are_worked_out_once_for_all_scanners(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    f = files(spark, **{"a.py": "eval(x)\n", ".env": "DEBUG=true\n", "requirements.txt": "lib==1.0\n"})
    advisories = spark.createDataFrame([("A-1", "PyPI", "lib", "0", "2.0", "HIGH", None, None)], dependencies.ADVISORY)
    found = scan(spark, f.mapInArrow(tell, f.schema), Options(secrets=True, sca=True, config=True), advisories).collect()
    assert {r.kind for r in found} == {"sast", "config", "sca"} and seen.value == 3
