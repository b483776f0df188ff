"""Command line: scan a folder, or score it against labels."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from argosec.operators import accuracy, reports
from argosec.operators.incremental import State
from argosec.plans.scan import Options, scan
from argosec.sources import http
from argosec.sources.inputs import git_head, load_advisories, load_allowlist, load_corpus
from argosec.sources.lockfiles import dependencies
from argosec.sources.rules import LANGUAGES
from argosec.sources.walk import walk


def _languages(text: str) -> tuple[str, ...]:
    short = {"js": "javascript", "ts": "typescript", "py": "python", "cs": "csharp"}
    names = tuple(short.get(x.strip(), x.strip()) for x in text.split(",") if x.strip())
    bad = [n for n in names if n not in LANGUAGES]
    if bad:
        raise SystemExit(f"unknown language: {', '.join(bad)}")
    return names


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="argosec")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("path")
    s.add_argument("--format", choices=("json", "sarif", "html"), default="json")
    s.add_argument("--output")
    s.add_argument("--lang", default="")
    s.add_argument("--rules")
    s.add_argument("--exclude-dir", action="append", default=[])
    s.add_argument("--group-by", choices=("file", "rule", "severity", "language"))
    s.add_argument("--allow-file")
    s.add_argument("--advisories", help="Parquet or JSON lines of advisories for --enable-sca")
    s.add_argument("--workers", type=int, default=0, help="local cores; 0 for all")
    s.add_argument("--osv", help="address of an advisory service for --enable-sca")
    s.add_argument("--sca-on-error", choices=("warn", "fail"), default="warn")
    s.add_argument("--state", help="folder of the incremental state; without it every file is scanned")
    s.add_argument("--no-cache", action="store_true")
    for flag in ("secrets", "sca", "framework-checks", "graphs"):
        s.add_argument(f"--enable-{flag}", action="store_true")
    u = sub.add_parser("upload")
    u.add_argument("--report", required=True)
    u.add_argument("--html")
    for q in (s, u):
        q.add_argument("--server")
        q.add_argument("--token", default=os.environ.get("ARGOSEC_TOKEN", ""))
        q.add_argument("--scan-label", default="")
        q.add_argument("--project-id", default="", help="accepted and not used: the token alone names the project")
    b = sub.add_parser("bench")
    b.add_argument("--corpus", required=True)
    b.add_argument("--min-recall", type=float, default=0.90)
    b.add_argument("--max-fp", type=int, default=0)
    b.add_argument("--json-out")
    b.add_argument("--md-out")
    b.add_argument("--advisories")
    b.add_argument("--enable-graphs", action="store_true")
    return p


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _upload(server: str, token: str, label: str, report: str, page: str | None, commit: str | None = None, branch: str | None = None) -> int:
    """Sends reports, the JSON one always ungrouped; 2 if that fails."""
    try:
        portal = http.Portal(server, token)
        scan_id = portal.create(scan_label=label, commit_sha=commit, branch=branch)
        portal.send_json(scan_id, report)
        if page:
            portal.send_html(scan_id, page)
        return 0
    except (http.HttpError, OSError, ValueError) as e:
        refused = isinstance(e, http.HttpError) and e.status == 401
        print("upload: the token is not valid" if refused else f"upload: {e}", file=sys.stderr)
        return 2


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if getattr(a, "project_id", ""):
        print("--project-id is not used: the token alone names the project", file=sys.stderr)
    if a.command == "upload":
        return _upload(a.server, a.token, a.scan_label, _text(a.report), _text(a.html) if a.html else None)
    build = SparkSession.builder.appName("argosec").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    if getattr(a, "workers", 0) > 0:
        build = build.master(f"local[{a.workers}]")
    spark = build.getOrCreate()
    adv = load_advisories(spark, a.advisories) if a.advisories else None
    if a.command == "scan":
        allow = load_allowlist(a.allow_file or os.path.join(a.path, ".zs-allow.yaml"), bool(a.allow_file))
        o = Options(_languages(a.lang), a.rules, a.enable_secrets, a.enable_sca, a.enable_framework_checks, a.enable_graphs, allow=allow)
        files = walk(spark, a.path, tuple(a.exclude_dir))
        vulnerable = None
        if a.enable_sca and a.osv:
            try:
                vulnerable = http.vulnerable(dependencies(files), a.osv).cache()
                vulnerable.count()
            except Exception as e:  # the service decides by --sca-on-error
                if a.sca_on_error == "fail":
                    raise
                print(f"advisories not read: {str(e)[:200]}", file=sys.stderr)
                vulnerable = None
        state = State(spark, a.state) if a.state and not a.no_cache else None
        found = scan(spark, files, o, adv, state=state, vulnerable_deps=vulnerable).cache()
        pieces = {"json": lambda: reports.json_pieces(found, a.group_by), "sarif": lambda: [reports.sarif(found)], "html": lambda: reports.html_pieces(found, a.group_by)}[a.format]()
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                f.writelines(pieces)
        else:
            sys.stdout.writelines(pieces)
            print()
        failed = bool(a.server) and _upload(a.server, a.token, a.scan_label, reports.json_report(found), reports.html_report(found), *git_head(a.path)) != 0
        return reports.exit_code(found.count(), failed)
    files, cases, expectations = load_corpus(spark, a.corpus)
    found = scan(spark, files, Options(secrets=True, sca=True, config=True, graphs=a.enable_graphs), adv)
    scores = accuracy.score(found, cases, expectations).cache()
    total = accuracy.gate(scores, a.min_recall, a.max_fp).first().asDict()
    rows = [[r.asDict() for r in accuracy.by(scores, c).orderBy(c).collect()] for c in ("language", "rule_id", "modality")]
    if a.json_out:
        import json

        with open(a.json_out, "w", encoding="utf-8") as f:
            json.dump({"summary": total, "by_language": rows[0], "by_rule": rows[1], "by_modality": rows[2]}, f)
    if a.md_out:
        with open(a.md_out, "w", encoding="utf-8") as f:
            f.write(reports.accuracy_markdown(total, rows[0], rows[1]))
    print(total)
    return int(not total["passed"])


if __name__ == "__main__":
    sys.exit(main())
