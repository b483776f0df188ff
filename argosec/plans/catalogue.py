"""All queries of the security engine and the SQL they are checked against."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosec.operators import accuracy, config_checks, dependencies, findings, intervals, matching, reports, symbols
from argosec.operators import incremental, secrets as sec
from argosec.operators import taint as tt
from argosec.operators.graph import cfg_edges, reaching
from argosec.parsers.front import ir_nodes
from argosec.plans.derived import PLANTED, cte, derived
from argosec.plans.scan import Options, incremental_sast, meta, sast, scan
from argosec.sources import config_kv, lockfiles, rules, walk
from argosec.sources.inputs import files_of_rows, load_allowlist
from argosec.storage import new_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def _bigints(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


# secrets
_LINES = "{t}_lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM {t})"


def _lines(t: str) -> str:
    return _LINES.format(t=t)


def _secret_hits(source: str) -> str:
    rows = []
    for rule, name, rx, floor, severity in sec.DETECTORS:
        rx = rx.replace("(?iu)", "(?i)").replace("'", "''")
        h = f"list_aggregate(string_split(regexp_extract(line, '{rx}', 1), ''), 'entropy')"
        rows.append(f"SELECT '{rule}' AS rule_id, '{name}' AS rule_name, '{severity}' AS severity, path, line_no, regexp_extract(line, '{rx}', 1) AS secret FROM {source} WHERE regexp_matches(line, '{rx}')" + (f" AND {h} >= {floor}" if floor else ""))
    return "hits AS (" + "\nUNION ALL ".join(rows) + "), secret_rows AS (SELECT rule_id, rule_name, severity, path, CAST(line_no AS BIGINT) AS line_no, round(list_aggregate(string_split(secret, ''), 'entropy'), 6) AS entropy, CASE WHEN length(secret) >= 4 THEN substr(secret, 1, 4) || '****' ELSE '****' END AS redacted, substr(sha256(rule_id || '|' || sha256(substr(secret, 1, 32))), 1, 16) AS fingerprint FROM hits)"


_SECRETS = cte("src_files") + ",\n" + _lines("src_files") + ",\n" + _secret_hits("src_files_lines")


@query(_SECRETS + " SELECT * FROM secret_rows")
def secrets_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bigints(sec.secrets(derived(spark, sf_dir, "src_files")))


@query(_SECRETS + " SELECT rule_id, severity, count(*) AS n, count(DISTINCT fingerprint) AS n_secrets, round(sum(entropy), 3) AS sum_entropy FROM secret_rows GROUP BY 1, 2")
def secrets_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secrets_findings(spark, sf_dir)
    return s.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("n_secrets"), F.round(F.sum("entropy"), 3).alias("sum_entropy"))


@query(_SECRETS + " SELECT path, count(*) AS n, min(line_no) AS first_line FROM secret_rows GROUP BY path HAVING count(*) >= 2")
def secrets_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_findings(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line")).where("n >= 2")


def _secrets_in(table: str, key: str, text: str):
    """The texts of a table, each with a line that holds a secret of one of the five kinds, a weak one or none."""
    planted = PLANTED.replace("{k}", key)
    src = f"WITH t AS (SELECT CAST({key} AS VARCHAR) AS path, {text} || chr(10) || {planted} AS content FROM {table} WHERE {text} IS NOT NULL AND {key} IS NOT NULL),\n" + _lines("t") + ",\n" + _secret_hits("t_lines")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(F.col(text).isNotNull() & F.col(key).isNotNull())
        return _bigints(sec.secrets(rows.select(F.col(key).cast("string").alias("path"), F.concat(text, F.lit("\n"), F.expr(planted)).alias("content"))))

    QUERIES[f"secrets_in_{table}"] = run
    ORACLE[f"secrets_in_{table}"] = src + " SELECT * FROM secret_rows"


for _t, _k, _c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")):
    _secrets_in(_t, _k, _c)


@query(cte("src_files") + ",\n" + _lines("src_files") + " SELECT line, count(*) AS n, count(DISTINCT path) AS n_files FROM src_files_lines GROUP BY line")
def lines_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.line_counts(derived(spark, sf_dir, "src_files"))


# walking
_EXT = "lower(regexp_extract(rel_path, '(\\.[^./]*)$', 1))"
_EXT_CASE = "CASE " + _EXT + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in walk.EXTENSIONS.items()) + " END"
_FIRST = "regexp_replace(string_split(content, chr(10))[1], chr(13) || '$', '')"
_SHEBANG = "CASE " + " ".join(f"WHEN {_FIRST} = '{k}' OR starts_with({_FIRST}, '{k} ') THEN '{v}'" for k, v in walk.SHEBANGS.items()) + " ELSE 'unknown' END"


@query(cte("src_paths") + f" SELECT coalesce({_EXT_CASE}, {_SHEBANG}) AS language, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM src_paths GROUP BY 1")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived(spark, sf_dir, "src_paths").withColumn("language", walk.language(F.col("rel_path"), F.col("content")))
    return p.groupBy("language").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


_IGNORE = walk.ignore_patterns([("", p) for p in (*walk.IGNORED, "docs/", "*.htm")] + [("pkg", "f1*"), ("src", "*.go")])


@query(
    cte("src_paths")
    + " SELECT event_id, rel_path FROM src_paths WHERE size <= 1048576 AND NOT list_has_any(string_split(rel_path, '/')[:-2], ["
    + ", ".join(f"'{d}'" for d in walk.PRUNED)
    + f"]) AND {_EXT} NOT IN ("
    + ", ".join(f"'{e}'" for e in walk.BINARY_EXTENSIONS)
    + ") AND NOT (" + " OR ".join(f"(starts_with(rel_path, '{o + '/' * bool(o)}') AND regexp_matches(rel_path, '{r}'))" for o, r in _IGNORE) + ")"
)
def walk_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived(spark, sf_dir, "src_paths").where(F.col("size") <= walk.MAX_BYTES)
    p = p.where(walk.keep_directories(F.col("rel_path")) & walk.keep_extension(F.col("rel_path")))
    return walk.not_ignored(p, spark.createDataFrame(_IGNORE, "owner string, regex string")).select("event_id", "rel_path")


_TREE_FILES = """SELECT s_suppkey AS k, CASE s_suppkey % 8 WHEN 0 THEN 'src/s' WHEN 1 THEN 'node_modules/m' WHEN 2 THEN 'sub/s' WHEN 3 THEN 'sub/s' WHEN 4 THEN 'lat/l' WHEN 5 THEN 'gone/g' WHEN 6 THEN '.cfg/_h' ELSE 'raw/b' END || CAST(s_suppkey AS STRING)
  || CASE s_suppkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.py' WHEN 3 THEN '.go' WHEN 4 THEN '.php' WHEN 5 THEN '.java' WHEN 6 THEN '.env' ELSE '.dat' END AS rel_path FROM {supplier}"""
_TREE_IGNORES = {".gitignore": "gone/\n", "sub/.gitignore": "*.py\n", "node_modules/x/.gitignore": "*.go\n"}
_BODIES = {4: (b"caf\xe9 ", 5), 7: (b"A\x00 ", 3)}  # Latin-1, and a zero byte: bytes and characters before the key; else 'x = '


def _plant(root: str):
    def run(batches):
        import pyarrow as pa

        from argosec.storage import worker_fs

        fs, bare = worker_fs(root)
        for b in batches:
            for k, rel in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs.create_dir(f"{bare}/{rel}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{bare}/{rel}", compression=None) as f:
                    f.write(_TREE_IGNORES[rel].encode() if k is None else _BODIES.get(k % 8, (b"x = ", 4))[0] + str(k).encode())
            yield pa.RecordBatch.from_arrays([b.column(1)], ["rel_path"])

    return run


@query(
    "WITH t AS (" + _TREE_FILES.replace("{supplier}", "supplier") + ") SELECT rel_path, CAST(length(CAST(k AS VARCHAR)) + CASE k % 8 WHEN 4 THEN 5 WHEN 7 THEN 3 ELSE 4 END AS BIGINT) AS size, k % 8 = 7 AS is_binary, CASE k % 8 WHEN 0 THEN 'python' WHEN 3 THEN 'go' WHEN 4 THEN 'php' ELSE 'unknown' END AS language, "
    "CAST(length(CAST(k AS VARCHAR)) + CASE k % 8 WHEN 4 THEN 5 WHEN 7 THEN 3 ELSE 4 END AS BIGINT) AS n_chars, sha256(CASE k % 8 WHEN 4 THEN unhex('636166E920') WHEN 7 THEN unhex('410020') ELSE unhex('78203D20') END || encode(CAST(k AS VARCHAR))) AS content_sha256 FROM t WHERE k % 8 NOT IN (1, 2, 5) "
    + "".join(f"UNION ALL SELECT '{p}', {len(c)}, false, 'unknown', {len(c)}, '{__import__('hashlib').sha256(c.encode()).hexdigest()}' " for p, c in _TREE_IGNORES.items() if "node_modules" not in p)
)
def walk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written tree with nested ignore files, a pruned folder, hidden files and a file that is no UTF-8, walked."""
    root = new_path(spark, "tree")
    files = spark.sql(_TREE_FILES.replace("{supplier}", f"parquet.`{sf_dir}/supplier.parquet`"))
    more = spark.createDataFrame([(None, p) for p in _TREE_IGNORES], "k long, rel_path string")
    files.select(F.col("k").cast("long").alias("k"), "rel_path").unionByName(more).mapInArrow(_plant(root), "rel_path string").count()
    return walk.walk(spark, root).select("rel_path", "size", "is_binary", "language", F.length("content").cast("long").alias("n_chars"), "content_sha256")


@query("SELECT event_id % 7 = 0 AS is_binary, count(*) AS n FROM events GROUP BY 1")
def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    odd = F.col("event_id") % 7 == 0
    # 'A' and a zero byte, or bytes whose hex digits hold 00 across a byte border
    head = F.concat(F.when(odd, F.unhex(F.lit("4100"))).otherwise(F.unhex(F.lit("1001"))), F.encode(F.repeat(F.lit("x"), F.pmod("event_id", F.lit(600)).cast("int")), "UTF-8"))
    return e.select(walk.is_binary(head).alias("is_binary")).groupBy("is_binary").agg(F.count("*").alias("n"))


# configuration
_CFG = " SELECT rule_id, severity, path, CAST(line AS BIGINT) AS line, key, value, substr(sha256(rule_id || '|' || path || '|' || key), 1, 16) AS fingerprint FROM found"


def _cfg(df: DataFrame) -> DataFrame:
    return _bigints(df.select("rule_id", "severity", "path", "line", "key", "value", "fingerprint"))


_ENV = (
    cte("env_files") + ",\n" + _lines("env_files")
    + r""", kv AS (SELECT path, line_no AS line, trim(split_part(regexp_replace(trim(line), '^export\s+', ''), '=', 1)) AS key,
  trim(substr(regexp_replace(trim(line), '^export\s+', ''), strpos(regexp_replace(trim(line), '^export\s+', ''), '=') + 1), ' "') AS value
  FROM env_files_lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND contains(line, '=')),
prod AS (SELECT * FROM kv WHERE NOT regexp_matches(lower(path), '\.(dev|development|dist|example|local|sample|test|testing)$') AND regexp_matches(path, '(/\.env[^/]*|\.env)$'))"""
)


@query(_ENV + ", found AS (SELECT 'ZS-CFG-001' AS rule_id, 'high' AS severity, * FROM prod WHERE key = 'DEBUG' AND lower(value) IN ('true', '1', 'yes', 'on'))" + _CFG)
def cfg_django_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cfg(config_checks.django_debug(derived(spark, sf_dir, "env_files")))


@query(_ENV + ", found AS (SELECT 'ZS-CFG-004' AS rule_id, 'high' AS severity, * FROM prod WHERE key = 'APP_DEBUG' AND lower(value) IN ('true', '1', 'yes', 'on') AND path NOT IN (SELECT path FROM prod WHERE key = 'APP_ENV' AND value = 'local'))" + _CFG)
def cfg_laravel_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cfg(config_checks.laravel_debug(derived(spark, sf_dir, "env_files")))


@query(cte("env_files") + ",\n" + _lines("env_files") + ", found AS (SELECT 'ZS-CFG-003' AS rule_id, 'medium' AS severity, path, line_no AS line, 'Access-Control-Allow-Origin' AS key, '*' AS value FROM env_files_lines WHERE regexp_matches(line, '(?i)origin[a-z_-]*[''\"]?\\s*[:=]\\s*[''\"]?\\*'))" + _CFG)
def cfg_cors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cfg(config_checks.wildcard_cors(derived(spark, sf_dir, "env_files")))


@query("""SELECT 'ZS-CFG-003' AS rule_id, 'medium' AS severity, CASE s_suppkey % 3 WHEN 0 THEN 'c' || s_suppkey || '.yml' ELSE 'c' || s_suppkey || '.go' END AS path, CAST(CASE s_suppkey % 3 WHEN 0 THEN 3 ELSE 2 END AS BIGINT) AS line FROM supplier WHERE s_suppkey % 3 <> 2""")
def cfg_cors_yaml_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcard origins in YAML lists and in sources; every third source names its origin."""
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.lit("cors:\n  allowed_origins:\n    - '*'\n")).when(k % 3 == 1, F.lit("package main\nw.Header().Set(\"Access-Control-Allow-Origin\", \"*\")\n")).otherwise(F.lit("package main\nw.Header().Set(\"Access-Control-Allow-Origin\", \"https://a.example\")\n"))
    f = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("c"), k.cast("string"), F.when(k % 3 == 0, ".yml").otherwise(".go")).alias("path"), text.alias("content"))
    return _bigints(config_checks.wildcard_cors(files_of_rows(f)).select("rule_id", "severity", "path", "line"))


_INI = cte("ini_files") + ",\n" + _lines("ini_files")


@query(_INI + r""", found AS (SELECT 'ZS-CFG-011' AS rule_id, 'medium' AS severity, path, line_no AS line, 'session.cookie_' || regexp_extract(line, 'cookie_(secure|httponly)', 1) AS key, 'off' AS value
  FROM ini_files_lines WHERE path LIKE '%/php.ini' AND regexp_matches(line, '(?i)^\s*session\.cookie_(secure|httponly)\s*=\s*(off|false|0)\s*$'))""" + _CFG)
def cfg_php_ini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cfg(config_checks.php_ini(derived(spark, sf_dir, "ini_files")))


@query(_INI + r""", found AS (SELECT 'ZS-CFG-007' AS rule_id, 'medium' AS severity, path, line_no AS line, 'customErrors' AS key, 'Off' AS value FROM ini_files_lines WHERE path LIKE '%/Web.config' AND contains(lower(line), 'customerrors mode="off"')
  UNION ALL SELECT 'ZS-CFG-008', 'medium', path, line_no, 'directoryBrowse', 'true' FROM ini_files_lines WHERE path LIKE '%/Web.config' AND contains(lower(line), 'directorybrowse enabled="true"'))""" + _CFG)
def cfg_aspnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived(spark, sf_dir, "ini_files")
    return _cfg(config_checks.aspnet_errors(f).unionByName(config_checks.aspnet_browse(f)))


@query(_INI + r""", found AS (SELECT 'ZS-CFG-005' AS rule_id, 'high' AS severity, path, line_no AS line, split_part(line, '=', 1) AS key, '*' AS value FROM ini_files_lines WHERE line = 'management.endpoints.web.exposure.include=*'
  UNION ALL SELECT 'ZS-CFG-006', 'medium', path, line_no, split_part(line, ':', 1), 'false' FROM ini_files_lines WHERE line = 'server.servlet.session.cookie.secure: false')""" + _CFG)
def cfg_spring(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived(spark, sf_dir, "ini_files")
    return _cfg(config_checks.spring_actuator(f).unionByName(config_checks.spring_cookie(f)))


@query(_INI + r""", found AS (SELECT 'ZS-CFG-002' AS rule_id, 'medium' AS severity, path, min(line_no) AS line, 'helmet' AS key, '' AS value FROM ini_files_lines
  WHERE path LIKE '%/server.js' AND regexp_matches(line, '\.listen\s*\(') AND path NOT IN (SELECT path FROM ini_files WHERE contains(lower(content), 'helmet')) GROUP BY path)""" + _CFG)
def cfg_express(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cfg(config_checks.express_without_helmet(derived(spark, sf_dir, "ini_files")))


@query(cte("php_files") + ",\n" + _lines("php_files") + r""", found AS (SELECT 'ZS-CFG-009' AS rule_id, 'medium' AS severity, path, line_no AS line, 'secure' AS key, 'false' AS value FROM php_files_lines WHERE path LIKE '%/config/session.php' AND contains(line, 'env(X, false)')
  UNION ALL SELECT 'ZS-CFG-009', 'medium', path, line_no, 'http_only', 'false' FROM php_files_lines WHERE path LIKE '%/config/session.php' AND contains(line, '=> FALSE')
  UNION ALL SELECT 'ZS-CFG-010', 'high', path, 3, '$except', '' FROM php_files WHERE contains(content, 'hooks/*'))""" + _CFG)
def cfg_laravel_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived(spark, sf_dir, "php_files")
    return _cfg(config_checks.laravel_session(f).unionByName(config_checks.csrf_except(f)))


@query(cte("ini_files") + ",\n" + _lines("ini_files") + r""" SELECT path, trim(regexp_extract(line, '^([^=:]*)[=:]', 1)) AS key, trim(regexp_extract(line, '^[^=:]*[=:](.*)$', 1)) AS value, CAST(line_no AS BIGINT) AS line
  FROM ini_files_lines WHERE path LIKE '%.properties' AND trim(line) <> '' AND NOT regexp_matches(line, '^[#!]')""")
def properties_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived(spark, sf_dir, "ini_files").where("path like '%.properties'")
    return _bigints(config_kv.property_entries(f))


@query()
def yaml_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    text = F.concat(F.lit("cors:\n  origins:\n    - '*'\n    - https://a\nname: s"), F.col("s_suppkey").cast("string"), F.lit("\nn: "), F.col("s_nationkey").cast("string"))
    return config_kv.yaml_entries(s.select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string"), F.lit(".yml")).alias("path"), text.alias("content")))


ORACLE["yaml_flatten"] = """SELECT 'c' || s_suppkey || '.yml' AS path, k.key AS key, CASE k.key WHEN 'cors.origins.0' THEN '*' WHEN 'cors.origins.1' THEN 'https://a' WHEN 'name' THEN 's' || s_suppkey ELSE CAST(s_nationkey AS VARCHAR) END AS value, CAST(k.line AS INT) AS line
FROM supplier, (VALUES ('cors.origins.0', 3), ('cors.origins.1', 4), ('name', 5), ('n', 6)) AS k(key, line)"""

# dependencies
_DEPS = cte("manifests") + ",\n" + _lines("manifests") + r""", deps AS (
  SELECT 'PyPI' AS ecosystem, trim(split_part(line, '==', 1)) AS package, trim(regexp_replace(split_part(line, '==', 2), ' #.*$', '')) AS version, path AS manifest, true AS direct
    FROM manifests_lines WHERE path LIKE '%/requirements.txt' AND contains(line, '==')
  UNION ALL SELECT 'Go', split_part(trim(regexp_replace(line, '^require ', '')), ' ', 1), split_part(trim(regexp_replace(line, '^require ', '')), ' ', 2), path, NOT contains(line, 'indirect')
    FROM manifests_lines WHERE path LIKE '%/go.mod' AND (starts_with(line, 'require one') OR starts_with(line, '  two'))
  UNION ALL SELECT 'npm', regexp_extract(content, '"(?:node_modules/)?(lib\d+)"', 1), regexp_extract(content, '"(?:node_modules/)?lib\d+":\{"version":"([^"]*)"', 1), path, true FROM manifests WHERE path LIKE '%/package-lock.json'
  UNION ALL SELECT 'npm', '@s/k', '2.0.0', path, false FROM manifests WHERE path LIKE '%/package-lock.json' AND contains(content, '@s/k')
  UNION ALL SELECT 'npm', 'a/node_modules/b', '3.0.0', path, false FROM manifests WHERE path LIKE '%/package-lock.json' AND contains(content, 'a/node_modules/b')
  UNION ALL SELECT 'PyPI', regexp_extract(content, '"(lib\d+)"', 1), regexp_extract(content, 'lib\d+":\{"version":"==([^"]*)"', 1), path, true FROM manifests WHERE path LIKE '%/Pipfile.lock'
  UNION ALL SELECT 'PyPI', 'dev', '0.1', path, false FROM manifests WHERE path LIKE '%/Pipfile.lock'),
once AS (SELECT ecosystem, package, version, manifest, direct FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, package, version ORDER BY manifest, direct DESC) AS k FROM deps) AS x WHERE k = 1)"""


def _deps_query(name: str, where: str, reader) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reader(derived(spark, sf_dir, "manifests"))

    QUERIES[name], ORACLE[name] = run, _DEPS + f" SELECT * FROM deps WHERE {where}"


_deps_query("deps_requirements", "manifest LIKE '%.txt'", lockfiles.requirements)
_deps_query("deps_gomod", "manifest LIKE '%go.mod'", lockfiles.go_mod)
_deps_query("deps_npm", "manifest LIKE '%package-lock.json'", lockfiles.npm)
_deps_query("deps_pipfile", "manifest LIKE '%Pipfile.lock'", lockfiles.pipfile)


@query(_DEPS + " SELECT * FROM once")
def deps_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockfiles.dependencies(derived(spark, sf_dir, "manifests"))


@query("SELECT 'npm' AS ecosystem, 'k' || p_partkey % 9 AS package, p_size || '.0' AS version, p_partkey || '/' || CASE p_partkey % 2 WHEN 0 THEN 'yarn.lock' ELSE 'pnpm-lock.yaml' END AS manifest, true AS direct FROM part")
def deps_yarn_pnpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 2).alias("odd"), F.concat(F.lit("k"), (F.col("p_partkey") % 9).cast("string")).alias("k"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("v"))
    yarn = F.concat(F.lit("# yarn\n\n"), "k", F.lit("@^1, "), "k", F.lit('@~1:\n  version "'), "v", F.lit('"\n  resolved x\n'))
    pnpm = F.concat(F.lit("lockfileVersion: '6.0'\npackages:\n  /"), "k", F.lit("@"), "v", F.lit(":\n    dev: true\n"))
    f = p.select(F.concat("id", F.when(F.col("odd") == 0, "/yarn.lock").otherwise("/pnpm-lock.yaml")).alias("path"), F.when(F.col("odd") == 0, yarn).otherwise(pnpm).alias("content"))
    return lockfiles.yarn(f).unionByName(lockfiles.pnpm(f))


@query("SELECT 'Maven' AS ecosystem, 'g' || p_partkey % 5 || ':a' AS package, CASE WHEN p_partkey % 3 = 0 THEN p_size || '.1' WHEN p_partkey % 3 = 1 THEN '2.' || p_size ELSE '4.0' END AS version, p_partkey || '/pom.xml' AS manifest, true AS direct FROM part")
def deps_maven(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    v = F.when(key % 3 == 0, F.lit("<version>${v}</version>")).when(key % 3 == 1, F.concat(F.lit("<version>[2."), size, F.lit(",3)</version>"))).otherwise(F.lit("<version>4.0</version>"))
    xml = F.concat(F.lit('<project xmlns="urn:pom"><properties><v>'), size, F.lit(".1</v></properties><dependencies><dependency><groupId>g"), (key % 5).cast("string"), F.lit("</groupId><artifactId>a</artifactId>"), v, F.lit("</dependency></dependencies></project>"))
    return lockfiles.maven(p.select(F.concat(key.cast("string"), F.lit("/pom.xml")).alias("path"), xml.alias("content")))


def _vkey(c: str) -> str:
    return f"list_transform([1,2,3,4,5,6], lambda i: coalesce(try_cast(string_split(regexp_extract(coalesce({c}, ''), '^[vV]?([0-9]+(\\.[0-9]+)*)', 1), '.')[i] AS BIGINT), 0))"


_VULN = _DEPS.replace("WITH RECURSIVE ", cte("advisories") + ",\n", 1) + f""", hit AS (
  SELECT o.*, a.id, a.introduced, a.fixed, a.severity AS raw FROM once AS o JOIN advisories AS a USING (ecosystem, package)
  WHERE {_vkey('o.version')} >= {_vkey('a.introduced')} AND (a.fixed IS NULL OR {_vkey('o.version')} < {_vkey('a.fixed')})),
best AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, package, version, manifest ORDER BY id) AS k, count(*) OVER (PARTITION BY ecosystem, package, version, manifest) AS n_advisories FROM hit)
SELECT ecosystem, package, version, manifest, direct, n_advisories, '>=' || introduced || CASE WHEN fixed IS NULL THEN '' ELSE ', <' || fixed END AS vulnerable_range, fixed AS fixed_version,
  CASE lower(coalesce(raw, '')) WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'low' THEN 'low' ELSE 'medium' END AS severity, CASE WHEN raw IS NULL THEN 'low' ELSE 'high' END AS confidence,
  substr(sha256(ecosystem || '|' || package || '|' || id), 1, 16) AS fingerprint FROM best WHERE k = 1"""


@query(_VULN)
def deps_advisory_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = dependencies.vulnerable(lockfiles.dependencies(derived(spark, sf_dir, "manifests")), derived(spark, sf_dir, "advisories"))
    return v.withColumn("n_advisories", F.size("advisory_ids").cast("bigint")).drop("advisory_ids")


# rules
@query(
    "SELECT language, severity, CASE WHEN kind <> 'call' OR coalesce(callee, '') = '' THEN 'kind' WHEN coalesce(suffix, false) AND contains(callee, '.') THEN 'suffix' ELSE 'callee' END AS idx_class, count(*) AS n "
    f"FROM read_json('{rules.CATALOGUE}', format = 'newline_delimited', columns = {{language: 'VARCHAR', severity: 'VARCHAR', kind: 'VARCHAR', callee: 'VARCHAR', suffix: 'BOOLEAN'}}) GROUP BY 1, 2, 3"
)
def rules_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules.with_index(rules.load_rules(spark))
    return r.groupBy("language", "severity", "idx_class").agg(F.count("*").alias("n"))


@query("SELECT sha256(string_agg(line, '' ORDER BY path)) AS hash FROM (SELECT n_name AS path, n_name || '|' || sha256(replace('a' || chr(13) || chr(10) || n_nationkey, chr(13) || chr(10), chr(10))) || chr(10) AS line FROM nation)")
def ruleset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return rules.rule_set_hash(n.select(F.col("n_name").alias("path"), F.concat(F.lit("a\r\n"), F.col("n_nationkey").cast("string")).alias("content")))


# trees
_TREE = cte("ir_tree")


@query(_TREE + " SELECT a.ix, count(*) AS n FROM ir_tree AS a JOIN ir_tree AS d ON d.ix > a.ix AND d.ix <= a.end_ix GROUP BY a.ix")
def ir_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, "ir_tree")
    return intervals.descendants(t, t.where("kind <> 'identifier'")).groupBy("ix").agg(F.count("*").alias("n"))


@query(_TREE + ", up AS (SELECT ix, parent_ix AS a_ix, 1 AS distance FROM ir_tree WHERE parent_ix >= 0 UNION ALL SELECT up.ix, t.parent_ix, distance + 1 FROM up JOIN ir_tree AS t ON t.ix = up.a_ix WHERE t.parent_ix >= 0) SELECT ix, a_ix, distance FROM up")
def ir_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, "ir_tree")
    return intervals.ancestors(t, t).select("ix", "a_ix", "distance")


@query(_TREE + " SELECT c.ix, c.text FROM ir_tree AS c WHERE c.kind = 'call' AND EXISTS (SELECT 1 FROM ir_tree AS k WHERE k.parent_ix = c.ix AND k.kind = 'identifier' AND k.text = 'c3')")
def ir_find_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.find_calls(derived(spark, sf_dir, "ir_tree"), "c3").select("ix", "text")


@query(_TREE + " SELECT kind, text, count(*) AS n FROM ir_tree WHERE kind = 'call' OR text = 'c7' GROUP BY 1, 2")
def ir_find_kind_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, "ir_tree")
    return intervals.find_by_kind(t, "call").unionByName(intervals.find_by_text(t, "c7")).groupBy("kind", "text").agg(F.count("*").alias("n"))


# matcher over derived calls
def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derived(spark, sf_dir, "call_nodes")
    arg = F.struct(F.lit("identifier").alias("kind"), F.col("arg").alias("text"), F.col("arg").alias("source"), F.lit(None).cast("string").alias("kwarg_name"), F.lit(None).cast("string").alias("kwarg_value"))
    kw = F.struct(F.lit("keyword_argument").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("string").alias("source"), F.col("kw").alias("kwarg_name"), F.col("kv").alias("kwarg_value"))
    none = {"text": "string", "lhs": "string", "rhs": "string", "attribute_texts": "array<string>", "except_handlers": "array<struct<is_bare:boolean,types:array<string>,is_empty_body:boolean>>"}
    return c.select("path", "language", "ix", F.lit("call").alias("kind"), "callee_text", F.regexp_extract("callee_text", r"([^.]*)\z", 1).alias("callee_last"), "argument_count", F.array(arg, kw).cast(matching._ARGS).alias("args"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()))


_RULES = [
    {"id": "R1", "name": "a", "language": "python", "kind": "call", "callee": "eval"},
    {"id": "R2", "name": "b", "language": "csharp", "kind": "call", "callee": "Response.Write", "suffix": True},
    {"id": "R3", "name": "c", "language": "python", "kind": "call", "callee": "app.run", "filters": [{"kwarg": {"name": "debug", "value_pattern": "^True$"}}]},
    {"id": "R4", "name": "d", "language": "go", "kind": "call", "callee": "rand.Int", "filters": [{"argument_count": 0}]},
    {"id": "R5", "name": "e", "language": "python", "kind": "call", "callee": "cursor.execute", "suffix": True, "filters": [{"tainted_argument": True}]},
    {"id": "R6", "name": "f", "language": "csharp", "kind": "call", "callee": "hashlib.md5", "filters": [{"not": {"kind": "call", "filters": [{"kwarg": {"name": "mode"}}]}}]},
    {"id": "R7", "name": "g", "language": "go", "kind": "call", "filters": [{"argument_identifier_matches": "^v[12]$"}, {"argument_count": 2}]},
]
_RULE_SQL = {
    "R1": "language = 'python' AND callee_text = 'eval'",
    "R2": "language = 'csharp' AND (callee_text = 'Response.Write' OR callee_text LIKE '%.Response.Write')",
    "R3": "language = 'python' AND callee_text = 'app.run' AND kw = 'debug' AND kv = 'True'",
    "R4": "language = 'go' AND callee_text = 'rand.Int' AND argument_count = 0",
    "R5": "language = 'python' AND callee_text LIKE '%.cursor.execute' AND arg = 'v1'",
    "R6": "language = 'csharp' AND callee_text = 'hashlib.md5' AND kw <> 'mode'",
    "R7": "language = 'go' AND arg IN ('v1', 'v2') AND argument_count = 2",
}


def _rule_rows(spark: SparkSession, ids: tuple[str, ...]) -> DataFrame:
    return _as_rules(spark, [r for r in _RULES if r["id"] in ids])


def _as_rules(spark: SparkSession, given: list[dict]) -> DataFrame:
    rows = [(json.dumps(rules._flat(r)),) for r in given]
    return spark.createDataFrame(rows, "j string").select(F.from_json("j", rules.RULE_SCHEMA).alias("r")).select("r.*")


def _rule_query(name: str, *ids: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = _calls(spark, sf_dir)
        tainted = nodes.select("path").distinct().select("path", F.lit("v1").alias("var"), F.lit(True).alias("tainted"))
        return matching.match(nodes, _rule_rows(spark, ids), tainted).select("path", "ix", F.col("rule.id").alias("rule_id"))

    QUERIES[name] = run
    ORACLE[name] = cte("call_nodes") + " " + " UNION ALL ".join(f"SELECT path, ix, '{i}' AS rule_id FROM call_nodes WHERE {_RULE_SQL[i]}" for i in ids)


_rule_query("rule_callee_join", "R1")
_rule_query("rule_suffix_join", "R2")
_rule_query("rule_kind_join", "R7")
_rule_query("rule_kwarg_filter", "R3")
_rule_query("rule_argument_count", "R4")
_rule_query("rule_tainted_argument", "R5")
_rule_query("rule_not_filter", "R6")
_rule_query("rule_match_all", *_RULE_SQL)


# each filter and pattern field on nodes of other kinds than calls
_FILTER_RULES = [
    {"id": "F1", "name": "lhs", "language": "python", "kind": "assignment", "lhs_identifier": "^pass"},
    {"id": "F2", "name": "rhs", "language": "python", "kind": "assignment", "rhs_literal": '^"x'},
    {"id": "F3", "name": "identifier", "language": "python", "kind": "identifier", "identifier": "Bad"},
    {"id": "F4", "name": "literal", "language": "python", "kind": "literal", "literal": "^[0-9]+$"},
    {"id": "F5", "name": "bare", "language": "python", "kind": "try", "filters": [{"has_bare_except": True}]},
    {"id": "F6", "name": "empty", "language": "python", "kind": "try", "filters": [{"has_empty_except_handler": True}]},
    {"id": "F7", "name": "attribute", "language": "python", "kind": "call", "filters": [{"has_attribute": "os.sys"}]},
    {"id": "F8", "name": "argument", "language": "python", "kind": "call", "filters": [{"argument_literal_matches": "^md5$"}]},
    {"id": "F9", "name": "tainted", "language": "python", "kind": "assignment", "filters": [{"tainted_rhs": True}]},
    {"id": "F10", "name": "not", "language": "python", "kind": "call", "filters": [{"not": {"kind": "call", "filters": [{"argument_count": 1}]}}]},
    {"id": "F11", "name": "not rhs", "language": "python", "kind": "assignment", "filters": [{"not": {"kind": "assignment", "rhs_literal": '^"x'}}]},
    {"id": "F12", "name": "not not", "language": "python", "kind": "call", "filters": [{"not": {"kind": "call", "filters": [{"not": {"kind": "call", "filters": [{"argument_count": 2}]}}]}}]},
    {"id": "F13", "name": "direct source", "language": "python", "kind": "call", "filters": [{"tainted_argument": True}]},
]
_FILTER_SQL = {
    "F1": "kind = 'assignment' AND lhs = 'password'", "F2": "kind = 'assignment' AND rhs = '\"x1\"'", "F3": "kind = 'identifier' AND text = 'Bad'", "F4": "kind = 'literal' AND text NOT IN ('Bad', 'md5')",
    "F5": "kind = 'try' AND bare", "F6": "kind = 'try' AND bare_body", "F7": "kind = 'call' AND argument_count = 0", "F8": "kind = 'call' AND text = 'md5'", "F9": "kind = 'assignment' AND arg = 'v1'",
    "F10": "kind = 'call' AND argument_count <> 1", "F11": "kind = 'assignment' AND rhs <> '\"x1\"'", "F12": "kind = 'call' AND argument_count = 2", "F13": "kind = 'call' AND (arg = 'v1' OR lhs = 'password')",
}


@query(cte("filter_nodes") + " " + " UNION ALL ".join(f"SELECT path, ix, '{i}' AS rule_id, {tv} AS tainted_var FROM filter_nodes WHERE {w}" for i, w in _FILTER_SQL.items() for tv in ["CASE WHEN arg = 'v1' THEN 'v1' ELSE 'request.args' END" if i == "F13" else "'v1'" if i == "F9" else "NULL"]))
def rule_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern fields, except handlers, attributes, literals, taint of a right-hand side and negations, nested ones too."""
    none = F.lit(None).cast("string")

    def arg(kind: str, text, source=none):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), source.alias("source"), none.alias("kwarg_name"), none.alias("kwarg_value"))

    direct = F.when(F.col("lhs") == "password", F.lit("request.args"))
    args = F.array(arg("identifier", F.col("arg"), F.col("arg")), arg("literal", F.col("text")), arg("attribute", F.lit(""), direct)).cast(matching._ARGS)
    call, handlers = F.col("kind") == "call", F.array(F.struct(F.col("bare").alias("is_bare"), F.array().cast("array<string>").alias("types"), F.col("bare_body").alias("is_empty_body")))
    n = derived(spark, sf_dir, "filter_nodes")
    n = n.select(
        "path", F.lit("python").alias("language"), "ix", "kind", F.when(call, "").otherwise(F.col("text")).alias("text"), F.when(call, "f").alias("callee_text"), F.when(call, "f").alias("callee_last"), "argument_count", "lhs", "rhs",
        F.when(call | ((F.col("kind") == "assignment")), F.when(F.col("kind") == "assignment", F.slice(args, 1, 1)).otherwise(args)).alias("args"), F.when(F.col("argument_count") == 0, F.array(F.lit("x.os.system"))).alias("attribute_texts"), F.when(F.col("kind") == "try", handlers).alias("except_handlers"),
    )
    tainted = n.select("path").distinct().select("path", F.lit("v1").alias("var"), F.lit(True).alias("tainted"))
    return matching.match(n, _as_rules(spark, _FILTER_RULES), tainted).select("path", "ix", F.col("rule.id").alias("rule_id"), "tainted_var")


# taint
_ASSIGN_NODES = ["path", "language", "ix", "end_ix", "lhs", "rhs", "augmented"]
_STEP = """CASE WHEN contains(l.rhs, 'html.escape(') THEN false WHEN l.rhs = 'request.args' THEN true WHEN l.name <> '' AND coalesce(list_contains(f.vars, l.name), false) THEN true
  WHEN l.augmented AND list_contains(f.vars, l.lhs) THEN true ELSE false END"""


@query(cte("assign_log") + f""", fold AS (
  SELECT path, 0 AS ix, CAST([] AS VARCHAR[]) AS vars, CAST([] AS VARCHAR[]) AS seen FROM (SELECT DISTINCT path FROM assign_log) AS p
  UNION ALL SELECT f.path, f.ix + 1, CASE WHEN {_STEP} THEN list_append(list_filter(f.vars, lambda v: v <> l.lhs), l.lhs) ELSE list_filter(f.vars, lambda v: v <> l.lhs) END,
    list_append(list_filter(f.seen, lambda v: v <> l.lhs), l.lhs) FROM fold AS f JOIN assign_log AS l ON l.path = f.path AND l.ix = f.ix + 1),
last AS (SELECT path, vars, seen FROM fold AS f WHERE ix = (SELECT max(ix) FROM assign_log AS l WHERE l.path = f.path))
SELECT path, v.var AS var, list_contains(vars, v.var) AS tainted FROM last, unnest(seen) AS v(var)""")
def taint_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = derived(spark, sf_dir, "assign_log")
    name = F.struct(F.lit("identifier").alias("kind"), F.col("name").alias("text"), F.col("name").alias("source"), F.lit(None).cast("string").alias("kwarg_name"), F.lit(None).cast("string").alias("kwarg_value"))
    n = a.select("path", F.lit("python").alias("language"), F.col("ix").cast("int").alias("ix"), F.col("ix").cast("int").alias("end_ix"), F.lit(0).alias("parent_ix"), F.lit(0).alias("child_pos"), F.lit("assignment").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("string").alias("callee_text"), "lhs", "rhs", "augmented", F.lit(None).cast("string").alias("return_expr"), F.lit(None).cast("string").alias("function_name"), F.lit(None).cast("array<string>").alias("parameters"), F.when(F.col("name") != "", F.array(name)).otherwise(F.array()).cast(matching._ARGS).alias("args"), F.col("ix").cast("int").alias("start_line"), F.lit(0).alias("start_col"))
    return tt.taint(n).select("path", "var", "tainted")


# symbols
_SYM = cte("scope_rows") + ", lines AS (SELECT DISTINCT path, CAST(start_line % 50 + 1 AS INT) AS line FROM scope_rows)"


def _sym(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = derived(spark, sf_dir, "scope_rows")
    return s, s.select("path", (F.col("start_line") % 50 + 1).cast("int").alias("line")).distinct()


@query(_SYM + " SELECT l.path, l.line, coalesce((SELECT name FROM scope_rows AS s WHERE s.path = l.path AND l.line BETWEEN s.start_line AND s.end_line ORDER BY seq LIMIT 1), '') AS symbol FROM lines AS l")
def enclosing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, lines = _sym(spark, sf_dir)
    return symbols.enclosing_symbol(lines, s)


@query(_SYM + " SELECT l.path, l.line, coalesce((SELECT seq FROM scope_rows AS s WHERE s.path = l.path AND l.line BETWEEN s.start_line AND s.end_line ORDER BY s.end_line - s.start_line, seq LIMIT 1), 0) AS scope_ix FROM lines AS l")
def scope_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, lines = _sym(spark, sf_dir)
    return symbols.scope_at(lines, s.withColumn("scope_ix", F.col("seq")))


@query(cte("scope_rows") + """, up AS (SELECT path, seq AS scope_ix, CAST(seq // 2 AS INT) AS parent_ix FROM scope_rows),
chain AS (SELECT path, scope_ix, scope_ix AS at, 0 AS distance FROM up UNION ALL SELECT c.path, c.scope_ix, u.parent_ix, distance + 1 FROM chain AS c JOIN up AS u ON u.path = c.path AND u.scope_ix = c.at WHERE u.parent_ix > 0),
found AS (SELECT c.path, c.scope_ix, c.distance, s.seq, s.kind FROM chain AS c JOIN scope_rows AS s ON s.path = c.path AND s.seq // 3 = c.at WHERE s.name = 'f1')
SELECT path, 'f1' AS name, scope_ix, seq, kind FROM (SELECT *, row_number() OVER (PARTITION BY path, scope_ix ORDER BY distance, seq) AS k FROM found) AS x WHERE k = 1""")
def resolve_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir, "scope_rows")
    sc = s.select("path", F.col("seq").alias("scope_ix"), F.when(F.expr("seq div 2") > 0, F.expr("cast(seq div 2 as int)")).alias("parent_ix"))
    sy = s.select("path", "name", "seq", F.expr("cast(seq div 3 as int)").alias("scope_ix"), "kind")
    names = sc.select("path", F.lit("f1").alias("name"), "scope_ix")
    return symbols.resolve(names, sy, sc)


# findings
_F = cte("findings_raw")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived(spark, sf_dir, "findings_raw")
    t = F.struct(F.when(F.col("kind") == "sast", F.col("var")).alias("source_var"), F.lit(None).cast("string").alias("source_expr"), F.lit("s").alias("sink"))
    return f.withColumn("taint", t).withColumn("metadata", F.lit(None).cast("map<string,string>")).withColumn("cwe", F.array(F.concat(F.lit("CWE-"), F.length("rule_id").cast("string"))))


_DEDUP = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, file, start_line, start_col, CASE WHEN kind = 'sca' THEN fingerprint ELSE '' END ORDER BY fingerprint, message) AS k FROM findings_raw) AS x WHERE k = 1)"


@query(_F + ", " + _DEDUP + " SELECT rule_id, file, start_line, fingerprint, message FROM d")
def dedup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.dedup(_raw(spark, sf_dir)).select("rule_id", "file", "start_line", "fingerprint", "message")


_ALLOW = [{"id": "ZS-X-1"}, {"id": "ZS-X-2", "path": "src/d1/**"}, {"id": "ZS-X-3", "path": "f{3,4}.py"}, {"fingerprint": "0" * 16}]
_ALLOWED = "(rule_id = 'ZS-X-1' OR (rule_id = 'ZS-X-2' AND file LIKE 'src/d1/%') OR (rule_id = 'ZS-X-3' AND (file LIKE '%/f3.py' OR file LIKE '%/f4.py')))"


@query(_F + f" SELECT rule_id, file, count(*) AS n FROM findings_raw WHERE NOT {_ALLOWED} GROUP BY 1, 2")
def allowlist_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:  # a driver-side input, like a user's file
        path = f"{folder}/allow.yaml"
        with open(path, "w", encoding="utf-8") as f:
            f.write("version: 1\nsuppressions:\n" + "".join(f"  - {json.dumps(e)}\n" for e in _ALLOW))
        allow = findings.allowlist(spark, load_allowlist(path))
    kept, _ = findings.suppressed(_raw(spark, sf_dir), allow)
    return kept.groupBy("rule_id", "file").agg(F.count("*").alias("n"))


@query(_F + f" SELECT count(*) AS n FROM findings_raw WHERE {_ALLOWED}")
def allowlist_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gone = findings.suppressed(_raw(spark, sf_dir), findings.allowlist(spark, _ALLOW))
    return gone.agg(F.count("*").alias("n"))


@query(_F + """ SELECT file, var, substr(sha256(file || '|' || var), 1, 12) AS chain_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS chain_rules, CAST(count(*) AS VARCHAR) AS chain_size, count(*) AS n
FROM findings_raw WHERE kind = 'sast' AND var <> '' GROUP BY file, var HAVING count(*) >= 2""")
def correlate_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = findings.correlate(_raw(spark, sf_dir)).where("metadata is not null")
    m = lambda k: F.col("metadata")[k].alias(k)
    return c.select("file", F.col("taint.source_var").alias("var"), m("chain_id"), m("chain_rules"), m("chain_size")).groupBy("file", "var", "chain_id", "chain_rules", "chain_size").agg(F.count("*").alias("n"))


@query(_F + """ SELECT dimension, value, count(*) AS n FROM (SELECT 'kind' AS dimension, kind AS value FROM findings_raw UNION ALL SELECT 'severity', severity FROM findings_raw
UNION ALL SELECT 'language', language FROM findings_raw WHERE language <> 'unknown' UNION ALL SELECT 'category', category FROM findings_raw WHERE category <> '') AS x GROUP BY 1, 2""")
def stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.stats(_raw(spark, sf_dir))


@query(_F + ", " + _DEDUP + " SELECT severity AS key, count(*) AS n, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank, min(file) AS first_file FROM d GROUP BY severity")
def group_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from argosec.functions.text import severity_rank

    g = findings.groups(findings.dedup(_raw(spark, sf_dir)), "severity")
    return g.select("key", "n", severity_rank(F.col("key")).alias("rank"), F.col("first.file").alias("first_file"))


@query(_F + ", " + _DEDUP + " SELECT file AS key, count(*) AS n, min(start_line) AS first_line FROM d GROUP BY file")
def group_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = findings.groups(findings.dedup(_raw(spark, sf_dir)), "file")
    return g.select("key", "n", F.col("first.start_line").alias("first_line"))


@query(_F + """, r AS (SELECT rule_id, min(file || lpad(CAST(start_line AS VARCHAR), 5, '0')) AS f, min_by(severity, file || lpad(CAST(start_line AS VARCHAR), 5, '0')) AS severity FROM findings_raw GROUP BY rule_id)
SELECT CAST(row_number() OVER (ORDER BY f, rule_id) - 1 AS INT) AS rule_index, rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, 'external/cwe/cwe-6' AS tag FROM r""")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_rules(_raw(spark, sf_dir)).select("rule_index", "rule_id", "level", F.col("tags")[0].alias("tag"))


@query(
    _F + ", " + _DEDUP + """, r AS (SELECT rule_id, min(file || lpad(CAST(start_line AS VARCHAR), 5, '0') || lpad(CAST(start_col AS VARCHAR), 5, '0')) AS f FROM d GROUP BY rule_id),
i AS (SELECT rule_id, row_number() OVER (ORDER BY f, rule_id) - 1 AS k FROM r)
SELECT rule_id, file, start_line, d.fingerprint, '{"ruleId":"' || rule_id || '","ruleIndex":' || i.k || ',"level":"' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END || '","message":{"text":"' || message
  || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file || '"},"region":{"startLine":' || greatest(start_line, 1) || CASE WHEN end_line > greatest(start_line, 1) THEN ',"endLine":' || end_line ELSE '' END || '}}}],"partialFingerprints":{"primary":"' || fingerprint || '"}}' AS result
FROM d JOIN i USING (rule_id)"""
)
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings.dedup(_raw(spark, sf_dir))
    return reports.sarif_results(f, reports.sarif_rules(f)).select("rule_id", "file", "start_line", "fingerprint", "result")


_SCORE = cte("findings_raw", "labels_x") + """, cases AS (SELECT DISTINCT file, language FROM labels_x),
f AS (SELECT r.file, CASE WHEN r.kind = 'sca' THEN 'dep:npm:' || replace(r.rule_id, 'ZS-X-', 'pkg') ELSE r.rule_id END AS key, r.kind, c.language FROM findings_raw AS r JOIN cases AS c USING (file)),
got AS (SELECT file, key, count(*) AS n FROM f GROUP BY 1, 2), e AS (SELECT file, language, modality, CASE WHEN package IS NOT NULL THEN 'dep:' || ecosystem || ':' || package ELSE rule_id END AS key, max(greatest(min_count, 1)) AS need FROM labels_x GROUP BY 1, 2, 3, 4),
s AS (SELECT e.file, e.language, e.modality, e.key AS rule_id, CASE WHEN coalesce(n, 0) >= need THEN 'TP' ELSE 'FN' END AS outcome, 1 AS n FROM e LEFT JOIN got USING (file, key)
  UNION ALL SELECT f.file, f.language, f.kind, f.key, 'FP', count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.file = f.file AND e.key = f.key) GROUP BY 1, 2, 3, 4)"""
_TFF = "CAST(coalesce(sum(CASE WHEN outcome = 'TP' THEN n END), 0) AS BIGINT) AS tp, CAST(coalesce(sum(CASE WHEN outcome = 'FP' THEN n END), 0) AS BIGINT) AS fp, CAST(coalesce(sum(CASE WHEN outcome = 'FN' THEN n END), 0) AS BIGINT) AS fn"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived(spark, sf_dir, "labels_x")
    package = F.struct(F.lit("npm").alias("ecosystem"), F.replace("rule_id", F.lit("ZS-X-"), F.lit("pkg")).alias("package"))
    f = _raw(spark, sf_dir).withColumn("dependency", F.when(F.col("kind") == "sca", package))
    return accuracy.score(f, e.select("file", "language"), e)


@query(_SCORE + f" SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, tp / (tp + fn) >= 0.9 AND fp <= 0 AS passed FROM (SELECT {_TFF} FROM s) AS x")
def accuracy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.gate(_scores(spark, sf_dir))


for _by in ("language", "rule_id", "modality"):
    QUERIES[f"accuracy_by_{_by}"] = lambda spark, sf_dir, by=_by: accuracy.by(_scores(spark, sf_dir), by)
    ORACLE[f"accuracy_by_{_by}"] = _SCORE + f" SELECT {_by}, {_TFF} FROM s GROUP BY {_by}"


# incremental
@query("SELECT 'f' || o_orderkey AS path, md5(o_orderstatus) AS content_sha256 FROM orders WHERE o_orderkey % 4 = 0")
def incremental_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived(spark, sf_dir, "file_versions")
    old = f.withColumn("content_sha256", F.when(F.expr("cast(substring(path, 2) as bigint) % 4 = 0"), "changed").otherwise(F.col("content_sha256")))
    return incremental.misses(f, old)


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS origin, count(*) AS n FROM orders GROUP BY 1")
def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived(spark, sf_dir, "file_versions")
    old = f.where("cast(substring(path, 2) as bigint) % 4 <> 0").withColumn("origin", F.lit("old"))
    return incremental.refresh(f, old, lambda x: x.select("path", F.lit("new").alias("origin"))).groupBy("origin").agg(F.count("*").alias("n"))


_CHANGED = "CASE WHEN s_suppkey % 4 = 0 THEN 'exec(y)' ELSE 'eval(x)' END"


@query(f"SELECT 's' || s_suppkey || '.py' AS file, CASE {_CHANGED} WHEN 'eval(x)' THEN 'ZS-PY-001' ELSE 'ZS-PY-033' END AS rule_id, s_suppkey % 4 = 0 AS computed FROM supplier")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans with a state in the shared folder; the second matches only the files whose content changed."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    path = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path")
    one, two = files_of_rows(s.select(path, F.lit("eval(x)\n").alias("content"))), files_of_rows(s.select(path, F.concat(F.expr(_CHANGED), F.lit("\n")).alias("content")))
    state = incremental.State(spark, new_path(spark, "state"))
    r, o = rules.load_rules(spark), Options()
    incremental_sast(one, r, o, state)
    missed = incremental.misses(two, state.table("findings", meta(o))).select(F.col("path").alias("missed"))
    found = incremental_sast(two, r, o, state)
    return found.join(missed, F.col("file") == F.col("missed"), "left").select("file", "rule_id", F.col("missed").isNotNull().alias("computed"))


# front ends over pages and generated sources
@query(r"SELECT page_id, len(regexp_extract_all(html, '(?is)<script>')) AS n_scripts, len(regexp_extract_all(html, '(?i)<a ')) AS n_links FROM pages")
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))
    n = ir_nodes(p)
    page = F.regexp_replace("path", "#.*", "").cast("bigint").alias("page_id")
    return n.groupBy(page).agg(F.count_if((F.col("kind") == "module") & (F.col("language") == "javascript")).alias("n_scripts"), F.count_if((F.col("kind") == "call") & (F.col("language") == "html") & (F.col("callee_text") == "a")).alias("n_links"))


# language: extension, source, findings as (rule, line, enclosing symbol, snippet, variable or expression that is tainted)
_TEMPLATES = {
    "python": (
        "py",
        "x = request.args.get('q')\n\ndef f(a):\n    return a\n\ny = f(x)\ncursor.execute(y)\neval(y)\n\nclass K:\n    def m(self, q):\n        try:\n            hashlib.new('md5')\n        except:\n            pass\n        assert q\n\nDEBUG = True\nresp['Access-Control-Allow-Origin'] = request.headers\n",
        [
            ("ZS-PY-001", 8, "", "eval(y)", None), ("ZS-PY-004", 7, "", "cursor.execute(y)", "y"), ("ZS-PY-023", 12, "K", "        try:\n            hashlib.new('md5')\n        except:\n            pass", None),
            ("ZS-PY-024", 12, "K", "        try:\n            hashlib.new('md5')\n        except:\n            pass", None), ("ZS-PY-056", 13, "K", "            hashlib.new('md5')", None), ("ZS-PY-009", 16, "K", "        assert q", None),
            ("ZS-PY-017", 18, "", "DEBUG = True", None), ("ZS-PY-030", 19, "", "resp['Access-Control-Allow-Origin'] = request.headers", "request.headers"),
        ],
    ),
    "javascript": ("js", "const q = req.query.q;\neval(q);\nel.innerHTML = q;\n", [("ZS-JS-001", 2, "", "eval(q);", "q"), ("ZS-JS-002", 3, "", "el.innerHTML = q;", "q")]),
    "typescript": (
        "ts",
        "const q: string = req.query.q as string;\nclass A {\n  run(v: string) {\n    try { exec(q); } catch (e) { }\n    const n = Math.random();\n  }\n}\nconst apiToken = 'abcdefgh12345678';\n",
        [("ZS-TS-005", 4, "A", "    try { exec(q); } catch (e) { }", None), ("ZS-TS-016", 4, "A", "    try { exec(q); } catch (e) { }", "q"), ("ZS-TS-021", 5, "A", "    const n = Math.random();", None), ("ZS-TS-012", 8, "", "const apiToken = 'abcdefgh12345678';", None)],
    ),
    "go": (
        "go",
        'package main\nimport "math/rand"\nfunc t(r *http.Request) int {\n\tc := tls.Config{InsecureSkipVerify: true}\n\tq := r.FormValue("q")\n\texec.Command(q)\n\treturn rand.Int()\n}\n',
        [("ZS-GO-021", 4, "t", "InsecureSkipVerify", None), ("ZS-GO-001", 6, "t", "\texec.Command(q)", "q"), ("ZS-GO-010", 7, "t", "\treturn rand.Int()", None)],
    ),
    "java": (
        "java",
        'class A {\n  void m(HttpServletRequest request) {\n    String q = request.getParameter("q");\n    stmt.executeQuery(q);\n    String password = "hunter2hunter2";\n    new File(q);\n    NoOpPasswordEncoder.getInstance();\n  }\n}\n',
        [("ZS-JAVA-001", 4, "A", "    stmt.executeQuery(q);", "q"), ("ZS-JAVA-005", 5, "A", '    String password = "hunter2hunter2";', None), ("ZS-JAVA-006", 6, "A", "    new File(q);", "q"), ("ZS-JAVA-007", 7, "A", "    NoOpPasswordEncoder.getInstance();", None)],
    ),
    "csharp": (
        "cs",
        'class A {\n  void M() {\n    var q = Request.QueryString["q"];\n    var c = new SqlCommand(q);\n    context.Response.Write(q);\n    MD5.Create();\n    string apiKey = "abcdef123456";\n    cmd.CommandText = q;\n  }\n}\n',
        [("ZS-CS-002", 4, "A", "    var c = new SqlCommand(q);", "q"), ("ZS-CS-004", 5, "A", "    context.Response.Write(q);", "q"), ("ZS-CS-005", 6, "A", "    MD5.Create();", None), ("ZS-CS-006", 7, "A", '    string apiKey = "abcdef123456";', None), ("ZS-CS-012", 8, "A", "    cmd.CommandText = q;", "q")],
    ),
    "php": (
        "php",
        "<?php\n$q = $_GET['q'];\nsystem($q);\necho $q;\n$safe = htmlspecialchars($q);\necho $safe;\nunserialize($safe);\n$password = 'hunter2hunter2';\n",
        [("ZS-PHP-001", 3, "", "system($q);", "$q"), ("ZS-PHP-004", 4, "", "echo $q;", "$q"), ("ZS-PHP-003", 7, "", "unserialize($safe);", None), ("ZS-PHP-005", 8, "", "$password = 'hunter2hunter2';", None)],
    ),
    "html": (
        "html",
        '<a href="x" target="_blank">l</a>\n<iframe src="https://a"></iframe>\n<script>\nvar q = location.hash;\neval(q);\n</script>\n',
        [("ZS-HTML-001", 1, "", '<a href="x" target="_blank">l</a>', None), ("ZS-HTML-004", 2, "", '<iframe src="https://a"></iframe>', None), ("ZS-JS-001", 5, "", "eval(q);", "q")],
    ),
}


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % len(_TEMPLATES)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    text = F.coalesce(*(F.when(k == i, F.lit(t[1])) for i, t in enumerate(_TEMPLATES.values())))
    suffix = F.coalesce(*(F.when(k == i, F.lit(t[0])) for i, t in enumerate(_TEMPLATES.values())))
    return files_of_rows(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("."), suffix).alias("path"), text.alias("content")))


def _q(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _values(*rows: tuple) -> str:
    return ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else _q(x) for x in r) + ")" for r in rows)


_EXPECTED = (
    "expected AS (SELECT 's' || s_suppkey || '.' || ext AS file, rule_id, CAST(start_line AS INT) AS start_line, symbol, snippet, CAST(source_var AS VARCHAR) AS source_var FROM supplier JOIN (VALUES "
    + _values(*((i, t[0], *e) for i, t in enumerate(_TEMPLATES.values()) for e in t[2]))
    + f") AS v(k, ext, rule_id, start_line, symbol, snippet, source_var) ON s_suppkey % {len(_TEMPLATES)} = k)"
)


@query("WITH " + _EXPECTED + r" SELECT file, rule_id, start_line, snippet, source_var, substr(sha256(rule_id || '|' || symbol || '|' || trim(regexp_replace(snippet, '\s+', ' ', 'g'))), 1, 16) AS fingerprint FROM expected")
def sast_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, taint, match and build findings for generated sources of all eight languages."""
    f = sast(_sources(spark, sf_dir), rules.load_rules(spark))
    return f.select("file", "rule_id", "start_line", F.col("evidence")[0]["snippet"].alias("snippet"), F.col("taint.source_var").alias("source_var"), "fingerprint")


# path suffix: symbols as (seq, name, kind, first line, last line, class or function around), scopes as (type, first line, last line)
_SYMBOLS = {
    "java": [(1, "A", "class", 1, 9), (2, "m", "function", 2, 8), (3, "request", "parameter", 2, 8), (4, "q", "variable", 3, 3), (5, "password", "variable", 5, 5)],
    "ts": [(1, "q", "variable", 1, 1), (2, "A", "class", 2, 7), (3, "run", "function", 3, 6), (4, "v", "parameter", 3, 6), (5, "n", "variable", 5, 5), (6, "apiToken", "variable", 8, 8)],
    "cs": [(1, "A", "class", 1, 10), (2, "M", "function", 2, 9), (3, "q", "variable", 3, 3), (4, "c", "variable", 4, 4), (5, "apiKey", "variable", 7, 7)],
}
_SCOPES = {"java": [("global", 1, 10), ("class", 1, 9), ("function", 2, 8)], "ts": [("global", 1, 9), ("class", 2, 7), ("function", 3, 6)], "cs": [("global", 1, 11), ("class", 1, 10), ("function", 2, 9)]}


def _of_suffix(found: dict, columns: str) -> str:
    rows = _values(*(([t[0] for t in _TEMPLATES.values()].index(e), e, *r) for e, v in found.items() for r in v))
    return f"SELECT 's' || s_suppkey || '.' || ext AS path, {columns} FROM supplier JOIN (VALUES {rows}) AS v(k, ext, {columns}) ON s_suppkey % {len(_TEMPLATES)} = k"


def _some_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir_nodes(_sources(spark, sf_dir).where(F.col("language").isin("java", "typescript", "csharp")))


@query(_of_suffix(_SYMBOLS, "seq, name, kind, start_line, end_line"))
def symbols_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol tables of parsed sources."""
    return symbols.symbols(_some_nodes(spark, sf_dir)).select("path", "seq", "name", "kind", "start_line", "end_line")


@query(_of_suffix(_SCOPES, "type, start_line, end_line"))
def scopes_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.scopes(_some_nodes(spark, sf_dir)).select("path", "type", "start_line", "end_line")


@query("SELECT 's' || s_suppkey || '.py' AS path, v.var, true AS tainted, CASE v.var WHEN 'x' THEN 'request.args.get(''q'')' WHEN 'y' THEN 'propagated from x' ELSE 'request.headers' END AS reason FROM supplier, (VALUES ('x'), ('y'), ('resp[''Access-Control-Allow-Origin'']')) AS v(var) WHERE s_suppkey % 8 = 0")
def python_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _sources(spark, sf_dir).where("language = 'python'")
    return tt.taint(ir_nodes(f)).where("tainted").select("path", "var", "tainted", "reason")


_FLOW = "def f(a):\n    x = 1\n    if a:\n        x = 2\n    y = x\n    return y\n"


def _flow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.concat(F.lit("g"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.lit(_FLOW).alias("content"))


@query("SELECT 'g' || s_suppkey || '.py' AS path, 'y' AS use_of, v.line AS def_line FROM supplier, (VALUES (2), (4)) AS v(line)")
def reaching_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ir_nodes(_flow_files(spark, sf_dir))
    a = n.where("kind = 'assignment'").select("path", "ix", "lhs", "start_line")
    r = reaching(n).where("var = 'x'").join(a.where("lhs = 'y'").select("path", "ix", F.col("lhs").alias("use_of")), ["path", "ix"])
    return r.join(a.select("path", F.col("ix").alias("def_ix"), F.col("start_line").alias("def_line")), ["path", "def_ix"]).select("path", "use_of", "def_line")


@query("SELECT kind, count(*) * n AS n FROM supplier, (VALUES ('true', 1), ('normal', 4), ('enter', 2), ('return', 1)) AS v(kind, n) GROUP BY kind, n")
def control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg_edges(ir_nodes(_flow_files(spark, sf_dir))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'g' || s_suppkey || '.py' AS path, 'f' AS fn, false AS always, false AS pass FROM supplier UNION ALL SELECT 's' || s_suppkey || '.py', v.fn, false, v.fn = 'f' FROM supplier, (VALUES ('f'), ('m')) AS v(fn) WHERE s_suppkey % 8 = 0")
def function_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flow_files(spark, sf_dir).unionByName(_sources(spark, sf_dir).where("language = 'python'").select("path", "language", "content"))
    return tt.function_summaries(ir_nodes(f)).select("path", "fn", "always", "pass")


_BY_RULE = {r["id"]: r["severity"] for r in rules.shipped()}


def _cfg_part(oracle: str) -> str:
    """The rows of a configuration query as findings."""
    return f"SELECT 'config' AS kind, rule_id, severity, path AS file, line AS start_line FROM ({oracle})"


@query(
    "WITH " + _EXPECTED + f", severities AS (SELECT * FROM (VALUES {_values(*sorted((i, v) for i, v in _BY_RULE.items() if any(i == e[0] for t in _TEMPLATES.values() for e in t[2])))}) AS v(rule_id, severity)), "
    "found AS (SELECT 'sast' AS kind, rule_id, severity, file, start_line FROM expected JOIN severities USING (rule_id) UNION ALL "
    + " UNION ALL ".join(_cfg_part(ORACLE[n]) for n in ("cfg_django_debug", "cfg_laravel_debug", "cfg_php_ini", "cfg_aspnet", "cfg_spring", "cfg_express", "cfg_laravel_files"))
    + f" UNION ALL SELECT 'sca', 'ZS-SCA-001', severity, manifest, row_number() OVER () FROM ({ORACLE['deps_advisory_join']})), once AS (SELECT DISTINCT * FROM found) "
    "SELECT kind, rule_id, severity, count(*) AS n, count(DISTINCT file) AS n_files FROM once GROUP BY 1, 2, 3"
)
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modalities over generated sources, configuration and manifests."""
    parts = [_sources(spark, sf_dir).select("path", "content")]
    parts += [derived(spark, sf_dir, t).select("path", "content") for t in ("env_files", "ini_files", "php_files", "manifests")]
    f = parts[0]
    for p in parts[1:]:
        f = f.unionByName(p)
    o = Options(secrets=True, sca=True, config=True, allow=[{"id": "ZS-CFG-003"}])
    out = scan(spark, files_of_rows(f), o, derived(spark, sf_dir, "advisories"))
    return out.groupBy("kind", "rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling windows over the event log, by the streaming operator on a batch."""
    from argosec.streaming.scan import events_per_window

    return events_per_window(spark.read.parquet(f"{sf_dir}/events.parquet"))


