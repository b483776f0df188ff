"""Input tables of the queries, derived from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from argosec.storage import spread

# name -> (tables it reads, SQL); tables stand in braces
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "src_files": (
        ("orders",),
        """SELECT concat('svc', CAST(o_orderkey % 20 AS STRING), '/conf_', CAST(o_orderkey AS STRING), '.txt') AS path,
  concat('# order ', CAST(o_orderkey AS STRING), chr(10),
    CASE WHEN o_orderkey % 3 = 0 THEN concat('api_key = "', md5(CAST(o_orderkey AS STRING)), '"') ELSE 'endpoint = "https://svc.example/api"' END, chr(10),
    CASE WHEN o_orderkey % 5 = 0 THEN concat('id AKIA', upper(substr(md5(CAST(o_orderkey AS STRING)), 1, 16)), ' end') ELSE 'region = eu' END, chr(10),
    CASE WHEN o_orderkey % 7 = 0 THEN 'password = "aaaaaaaaaa"' WHEN o_orderkey % 7 = 1 THEN concat('Passwd: ', chr(39), 'P', substr(md5(CAST(o_orderkey AS STRING)), 1, 9), chr(39)) ELSE 'user = app' END, chr(10),
    CASE WHEN o_orderkey % 11 = 0 THEN '-----BEGIN RSA PRIVATE KEY-----' ELSE '' END, chr(10),
    CASE WHEN o_orderkey % 13 = 0 THEN concat('t=ghp_', md5(CAST(o_orderkey AS STRING)), substr(md5(CAST(o_orderkey AS STRING)), 1, 4)) ELSE 'done' END) AS content
FROM {orders}""",
    ),
    "src_paths": (
        ("events",),
        """SELECT event_id,
  concat(CASE event_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/lib/' WHEN 2 THEN 'app/build/' WHEN 3 THEN 'docs/' WHEN 4 THEN '' ELSE 'pkg/test/' END, 'f', CAST(event_id AS STRING),
    CASE event_id % 11 WHEN 0 THEN '.py' WHEN 1 THEN '.JS' WHEN 2 THEN '.tsx' WHEN 3 THEN '.go' WHEN 4 THEN '.java' WHEN 5 THEN '.cs' WHEN 6 THEN '.php' WHEN 7 THEN '.htm' WHEN 8 THEN '.min.js' WHEN 9 THEN '.png' ELSE '' END) AS rel_path,
  CASE event_id % 5 WHEN 0 THEN concat('#!/usr/bin/env python3', chr(13), chr(10), 'x') WHEN 1 THEN concat('#!/usr/bin/node --harmony', chr(10)) WHEN 2 THEN concat('#!/usr/bin/pythonx', chr(10)) WHEN 3 THEN 'plain' ELSE '' END AS content,
  event_id * 37 % 2000000 AS size
FROM {events}""",
    ),
    "env_files": (
        ("supplier",),
        """SELECT concat('app', CAST(s_suppkey AS STRING), CASE s_suppkey % 4 WHEN 0 THEN '/.env' WHEN 1 THEN '/prod.env' WHEN 2 THEN '/.env.example' ELSE '/.env.production' END) AS path,
  concat('# settings', chr(10), CASE WHEN s_suppkey % 2 = 0 THEN 'export DEBUG="True"' ELSE 'DEBUG=0' END, chr(10),
    CASE WHEN s_suppkey % 3 = 0 THEN 'APP_DEBUG=on' ELSE 'APP_DEBUG=false' END, chr(10),
    CASE WHEN s_suppkey % 5 = 0 THEN 'APP_ENV=local' ELSE 'APP_ENV=production' END, chr(10),
    CASE WHEN s_suppkey % 7 = 0 THEN 'CORS_ORIGIN=*' ELSE 'CORS_ORIGIN=https://a.example' END) AS content
FROM {supplier}""",
    ),
    "ini_files": (
        ("supplier",),
        """SELECT concat('host', CAST(s_suppkey AS STRING), CASE s_suppkey % 4 WHEN 0 THEN '/php.ini' WHEN 1 THEN '/Web.config' WHEN 2 THEN '/application.properties' ELSE '/server.js' END) AS path,
  CASE s_suppkey % 4
    WHEN 0 THEN concat('session.cookie_secure = ', CASE WHEN s_suppkey % 3 = 0 THEN 'Off' ELSE 'On' END, chr(10), 'session.cookie_httponly=', CASE WHEN s_suppkey % 5 = 0 THEN '0' ELSE '1' END)
    WHEN 1 THEN concat('<system.web>', chr(10), '<customErrors mode="', CASE WHEN s_suppkey % 3 = 0 THEN 'Off' ELSE 'RemoteOnly' END, '"/>', chr(10), '<directoryBrowse enabled="', CASE WHEN s_suppkey % 5 = 0 THEN 'TRUE' ELSE 'false' END, '"/>')
    WHEN 2 THEN concat('! spring', chr(10), 'management.endpoints.web.exposure.include=', CASE WHEN s_suppkey % 3 = 0 THEN '*' ELSE 'health' END, chr(10), 'server.servlet.session.cookie.secure: ', CASE WHEN s_suppkey % 5 = 0 THEN 'false' ELSE 'true' END)
    ELSE concat('const app = express()', chr(10), CASE WHEN s_suppkey % 3 = 0 THEN 'app.use(helmet())' ELSE '' END, chr(10), CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'app.listen(3000)' END, chr(10), 'server.listen(1)') END AS content
FROM {supplier}""",
    ),
    "php_files": (
        ("supplier",),
        """SELECT concat('l', CAST(s_suppkey AS STRING), CASE s_suppkey % 2 WHEN 0 THEN '/config/session.php' ELSE '/VerifyCsrfToken.php' END) AS path,
  CASE s_suppkey % 2
    WHEN 0 THEN concat('<?php', chr(10), '  ', chr(39), 'secure', chr(39), ' => ', CASE WHEN s_suppkey % 3 = 0 THEN 'env(X, false)' ELSE 'true' END, ',', chr(10), '  ', chr(39), 'http_only', chr(39), ' => ', CASE WHEN s_suppkey % 5 = 0 THEN 'FALSE' ELSE 'true' END)
    ELSE concat('<?php', chr(10), 'class V {', chr(10), '  protected $except = [', CASE WHEN s_suppkey % 3 = 0 THEN concat(chr(10), chr(39), 'hooks/*', chr(39)) ELSE '' END, '];', chr(10), '}') END AS content
FROM {supplier}""",
    ),
    "manifests": (
        ("part",),
        """SELECT concat('p', CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '/requirements.txt' WHEN 1 THEN '/go.mod' WHEN 2 THEN '/package-lock.json' ELSE '/Pipfile.lock' END) AS path,
  CASE p_partkey % 4
    WHEN 0 THEN concat('# pins', chr(10), 'lib', CAST(p_partkey % 50 AS STRING), '==', CAST(p_size % 9 AS STRING), '.', CAST(p_partkey % 10 AS STRING), ' # note', chr(10), 'loose>=1', chr(10), '-r other.txt', chr(10), 'tool == 1.', CAST(p_size % 3 AS STRING))
    WHEN 1 THEN concat('module m', chr(10), 'require one.example/x v', CAST(p_size % 9 AS STRING), '.0.0', chr(10), 'require (', chr(10), '  two.example/y', CAST(p_partkey % 50 AS STRING), ' v1.', CAST(p_size % 9 AS STRING), '.0 // indirect', chr(10), '  bad', chr(10), ')', chr(10), 'exclude (', chr(10), '  three.example/z v1.0.0', chr(10), ')')
    WHEN 2 THEN CASE WHEN p_partkey % 8 = 2 THEN concat('{"lockfileVersion":1,"dependencies":{"lib', CAST(p_partkey % 50 AS STRING), '":{"version":"', CAST(p_size % 9 AS STRING), '.1.0"},"@s/k":{"version":"2.0.0"}}}')
      ELSE concat('{"lockfileVersion":3,"packages":{"":{"version":"1.0.0"},"node_modules/lib', CAST(p_partkey % 50 AS STRING), '":{"version":"', CAST(p_size % 9 AS STRING), '.2.0"},"node_modules/a/node_modules/b":{"version":"3.0.0"}}}') END
    ELSE concat('{"default":{"lib', CAST(p_partkey % 50 AS STRING), '":{"version":"==', CAST(p_size % 9 AS STRING), '.3"}},"develop":{"dev":{"version":"==0.1"}}}') END AS content
FROM {part}""",
    ),
    "advisories": (
        ("part",),
        """SELECT concat('ADV-', CAST(p_partkey AS STRING)) AS id, CASE p_partkey % 3 WHEN 0 THEN 'PyPI' WHEN 1 THEN 'npm' ELSE 'Go' END AS ecosystem,
  CASE WHEN p_partkey % 7 <> 0 THEN concat('elsewhere', CAST(p_partkey % 50 AS STRING)) WHEN p_partkey % 3 = 2 THEN concat('two.example/y', CAST(p_partkey % 50 AS STRING)) ELSE concat('lib', CAST(p_partkey % 50 AS STRING)) END AS package,
  concat(CAST(p_size % 4 AS STRING), '.0') AS introduced, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(CAST(p_size % 4 + 2 AS STRING), '.0') END AS fixed,
  CASE p_partkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'Low' ELSE NULL END AS severity
FROM {part}""",
    ),
    "ir_tree": (
        ("region", "nation", "customer"),
        """WITH t AS (
  SELECT 'tree' AS path, r_regionkey AS a, -1 AS b, -1 AS c, 'module' AS kind, r_name AS text FROM {region}
  UNION ALL SELECT 'tree', n_regionkey, n_nationkey, -1, 'call', n_name FROM {nation}
  UNION ALL SELECT 'tree', n_regionkey, n_nationkey, c_custkey, 'identifier', concat('c', CAST(c_custkey % 10 AS STRING)) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey),
o AS (SELECT *, CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS INT) AS ix FROM t)
SELECT path, ix, CAST(CASE WHEN c >= 0 THEN ix WHEN b >= 0 THEN max(ix) OVER (PARTITION BY a, b) ELSE max(ix) OVER (PARTITION BY a) END AS INT) AS end_ix,
  CAST(CASE WHEN c >= 0 THEN min(ix) OVER (PARTITION BY a, b) WHEN b >= 0 THEN min(ix) OVER (PARTITION BY a) ELSE -1 END AS INT) AS parent_ix, kind, text
FROM o""",
    ),
    "call_nodes": (
        ("part",),
        """SELECT concat('f', CAST(p_partkey % 100 AS STRING), '.src') AS path, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'csharp' ELSE 'go' END AS language, CAST(p_partkey AS INT) AS ix,
  CASE p_partkey % 10 WHEN 0 THEN 'eval' WHEN 1 THEN 'os.system' WHEN 2 THEN 'context.Response.Write' WHEN 3 THEN 'XResponse.Write' WHEN 4 THEN 'Response.Write' WHEN 5 THEN 'hashlib.md5' WHEN 6 THEN 'app.run' WHEN 7 THEN 'rand.Int' WHEN 8 THEN 'db.cursor.execute' ELSE 'print' END AS callee_text,
  CAST(p_size % 3 AS INT) AS argument_count, CASE p_partkey % 4 WHEN 0 THEN 'debug' WHEN 1 THEN 'verify' ELSE 'mode' END AS kw, CASE WHEN p_partkey % 7 = 0 THEN 'True' ELSE 'False' END AS kv,
  concat('v', CAST(p_size % 5 AS STRING)) AS arg
FROM {part}""",
    ),
    "assign_log": (
        ("events",),
        """SELECT concat('u', CAST(user_id AS STRING), '.py') AS path, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS ix, concat('v', CAST(event_id % 3 AS STRING)) AS lhs,
  CASE event_type WHEN 'view' THEN concat('v', CAST((event_id + 1) % 3 AS STRING)) WHEN 'click' THEN 'request.args' WHEN 'signup' THEN concat('html.escape(v', CAST((event_id + 1) % 3 AS STRING), ')') WHEN 'purchase' THEN '1' ELSE concat('v', CAST(event_id % 3 AS STRING), ' + 2') END AS rhs,
  CASE event_type WHEN 'view' THEN concat('v', CAST((event_id + 1) % 3 AS STRING)) WHEN 'error' THEN concat('v', CAST(event_id % 3 AS STRING)) ELSE '' END AS name,
  event_type = 'purchase' AND event_id % 2 = 0 AS augmented
FROM {events}""",
    ),
    "findings_raw": (
        ("lineitem",),
        """SELECT concat('ZS-X-', CAST(l_linenumber AS STRING)) AS rule_id, concat('rule ', CAST(l_linenumber AS STRING)) AS rule_name, CASE l_linenumber % 3 WHEN 0 THEN 'injection' WHEN 1 THEN 'xss' ELSE '' END AS category,
  CASE l_linenumber % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, 'high' AS confidence, concat('m', CAST(l_suppkey % 3 AS STRING)) AS message,
  CASE WHEN l_partkey % 5 = 0 THEN 'sca' WHEN l_partkey % 5 = 1 THEN 'secret' ELSE 'sast' END AS kind, CASE l_suppkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'java' ELSE 'unknown' END AS language,
  concat('src/d', CAST(l_suppkey % 7 AS STRING), '/f', CAST(l_partkey % 40 AS STRING), '.py') AS file, CAST(l_orderkey % 30 AS INT) AS start_line, CAST(0 AS INT) AS start_col, CAST(l_orderkey % 30 + l_linenumber % 2 AS INT) AS end_line, CAST(5 AS INT) AS end_col,
  substr(md5(concat(CAST(l_partkey % 40 AS STRING), '|', CAST(l_linenumber AS STRING), '|', CAST(l_suppkey % 2 AS STRING))), 1, 16) AS fingerprint, CASE WHEN l_partkey % 3 = 0 THEN concat('v', CAST(l_orderkey % 4 AS STRING)) ELSE '' END AS var
FROM {lineitem}""",
    ),
    "scope_rows": (
        ("customer",),
        """SELECT concat('m', CAST(c_nationkey AS STRING), '.py') AS path, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS seq, concat('f', CAST(c_custkey % 6 AS STRING)) AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'class' ELSE 'function' END AS kind, CAST(c_custkey % 40 + 1 AS INT) AS start_line, CAST(c_custkey % 40 + 1 + c_custkey % 17 AS INT) AS end_line
FROM {customer}""",
    ),
    "labels_x": (
        ("lineitem",),
        """SELECT DISTINCT concat('src/d', CAST(l_suppkey % 7 AS STRING), '/f', CAST(l_partkey % 40 AS STRING), '.py') AS file, CASE l_suppkey % 7 % 2 WHEN 0 THEN 'python' ELSE 'go' END AS language,
  CASE WHEN l_linenumber = 2 THEN 'sca' ELSE 'sast' END AS modality,
  CASE WHEN l_linenumber = 2 THEN NULL WHEN l_partkey % 40 < 20 AND l_linenumber < 5 THEN concat('ZS-X-', CAST(l_linenumber AS STRING)) ELSE concat('ZS-Y-', CAST(l_linenumber AS STRING)) END AS rule_id,
  CASE WHEN l_linenumber = 2 THEN concat('pkg', CAST(l_partkey % 40 % 4 AS STRING)) END AS package, CASE WHEN l_linenumber = 2 THEN 'npm' END AS ecosystem, CAST(l_linenumber % 3 * 40 AS INT) AS min_count
FROM {lineitem}""",
    ),
    "filter_nodes": (
        ("part",),
        """SELECT concat('n', CAST(p_partkey % 90 AS STRING), '.py') AS path, CAST(p_partkey AS INT) AS ix,
  CASE p_partkey % 5 WHEN 0 THEN 'assignment' WHEN 1 THEN 'identifier' WHEN 2 THEN 'literal' WHEN 3 THEN 'try' ELSE 'call' END AS kind,
  CASE p_size % 3 WHEN 0 THEN 'Bad' WHEN 1 THEN CAST(p_size AS STRING) ELSE 'md5' END AS text, CASE p_size % 4 WHEN 0 THEN 'password' WHEN 1 THEN 'my_pass' ELSE 'other' END AS lhs,
  CASE p_size % 6 WHEN 0 THEN '"x1"' WHEN 1 THEN 'x1' ELSE '"y"' END AS rhs, concat('v', CAST(p_size % 5 AS STRING)) AS arg, p_size % 7 = 0 AS bare, p_size % 8 = 0 AS bare_body, CAST(p_size % 3 AS INT) AS argument_count
FROM {part}""",
    ),
    "file_versions": (
        ("orders",),
        """SELECT concat('f', CAST(o_orderkey AS STRING)) AS path, sha256_hex AS content_sha256 FROM (SELECT o_orderkey, md5(o_orderstatus) AS sha256_hex FROM {orders}) AS x""",
    ),
}


def _fill(name: str, where) -> str:
    tables, text = SQL[name]
    for t in tables:
        text = text.replace("{" + t + "}", where(t))
    return text


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.sql(_fill(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`")))


def cte(*names: str) -> str:
    """The same tables as WITH clauses for DuckDB."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_fill(n, str)})" for n in names)


# a line with a secret of one of five kinds, or none, by a whole-number key; Spark and DuckDB read it alike
PLANTED = """CASE {k} % 7 WHEN 0 THEN concat('id AKIA', upper(substr(md5(CAST({k} AS STRING)), 1, 16)), ' end') WHEN 1 THEN concat('t=ghp_', md5(CAST({k} AS STRING)), substr(md5(CAST({k} AS STRING)), 1, 4))
  WHEN 2 THEN concat('api_key: ', md5(CAST({k} AS STRING))) WHEN 3 THEN concat('password = "', substr(md5(CAST({k} AS STRING)), 1, 12), '"') WHEN 4 THEN '-----BEGIN EC PRIVATE KEY-----' WHEN 5 THEN 'password = "aaaaaaaaaaaa"' ELSE 'nothing here' END"""
