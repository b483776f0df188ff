"""Framework configuration checks: scan, filter, project.

Result: (rule_id, framework, severity, path, line, key, value, fingerprint).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosec.functions.text import base_name, digest
from argosec.sources.config_kv import env_entries, file_named, property_entries, yaml_entries
from argosec.sources.walk import lines

NON_PROD_SUFFIX = r"\.(?:dev|development|dist|example|local|sample|test|testing)\z"
_QUOTE, _IS = r"[\x22\x27]?", r"\s*=\s*"
_LOW_PATH = lambda: F.lower("path")


def _truthy(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("on", "yes", "1", "true")


def _out(df: DataFrame, rule: str, framework: str, severity: str, key: Column | str, value: Column | str, line: str = "line") -> DataFrame:
    k, v = (x if isinstance(x, Column) else F.lit(x) for x in (key, value))
    return df.select(F.lit(rule).alias("rule_id"), F.lit(framework).alias("framework"), F.lit(severity).alias("severity"), "path", F.col(line).cast("int").alias("line"), k.alias("key"), v.alias("value"), digest(F.lit(rule), F.col("path"), k).alias("fingerprint"))


def _first(df: DataFrame, key: str) -> DataFrame:
    """The first entry of a key in each file."""
    return df.where(F.col("key") == key).groupBy("path").agg(F.min_by(F.struct("value", "line"), "line").alias("e")).select("path", "e.value", "e.line")


def _env_files(files: DataFrame) -> DataFrame:
    return files.where(file_named(r"\A\.env|\.env\z") & ~F.lower(base_name(F.col("path"))).rlike(NON_PROD_SUFFIX))


def django_debug(files: DataFrame) -> DataFrame:
    return _out(_first(env_entries(_env_files(files)), "DEBUG").where(_truthy(F.col("value"))), "ZS-CFG-001", "django", "high", "DEBUG", F.col("value"))


def express_without_helmet(files: DataFrame) -> DataFrame:
    use = files.where(_LOW_PATH().rlike(r"\.(?:js|mjs|ts)\z") & F.col("content").rlike(r"\bexpress\s*\(") & ~F.lower("content").contains("helmet"))
    first = lines(use).where(F.col("line").rlike(r"\.listen\s*\(")).groupBy("path").agg(F.min("line_no").alias("line"))
    return _out(first, "ZS-CFG-002", "express", "medium", "helmet", "")


def wildcard_cors(files: DataFrame) -> DataFrame:
    yml = files.where(_LOW_PATH().rlike(r"\.ya?ml\z"))
    entries = yaml_entries(yml).where(F.lower("key").contains("origin") & (F.trim("value") == "*"))
    code = lines(files.where(_LOW_PATH().rlike(r"\.(?:cs|go|java|php)\z"))).where(F.col("line").rlike(rf"(?iu)access-control-allow-origin{_QUOTE}\s*[,:=]\s*{_QUOTE}\*"))
    text = lines(files.where(_LOW_PATH().rlike(r"\.(?:conf|json|env)\z") | file_named(r"\A\.env"))).where(F.col("line").rlike(rf"(?iu)origin[-_a-z]*{_QUOTE}\s*[=:]\s*{_QUOTE}\*"))
    rows = code.unionByName(text).select("path", F.col("line_no").alias("line"), F.lit("Access-Control-Allow-Origin").alias("key"))
    rows = rows.unionByName(entries.select("path", "line", "key"))
    return _out(rows, "ZS-CFG-003", "cors", "medium", F.col("key"), "*")


def laravel_debug(files: DataFrame) -> DataFrame:
    e = env_entries(_env_files(files))
    calm = _first(e, "APP_ENV").where(F.lower(F.trim("value")).isin("dev", "development", "local", "test", "testing")).select("path")
    return _out(_first(e, "APP_DEBUG").where(_truthy(F.col("value"))).join(calm, "path", "left_anti"), "ZS-CFG-004", "laravel", "high", "APP_DEBUG", F.col("value"))


def _spring(files: DataFrame, key: str) -> DataFrame:
    named = files.where(file_named(r"\Aapplication.*\.(?:properties|ya?ml)\z"))
    props = property_entries(named.where(_LOW_PATH().endswith(".properties")))
    return props.unionByName(yaml_entries(named.where(~_LOW_PATH().endswith(".properties")))).where(F.col("key").rlike(rf"\A{key}(?:\.\d+)?\z"))


def spring_actuator(files: DataFrame) -> DataFrame:
    key = "management.endpoints.web.exposure.include"
    return _out(_spring(files, key.replace(".", r"\.")).where(F.trim("value") == "*"), "ZS-CFG-005", "spring", "high", key, "*")


def spring_cookie(files: DataFrame) -> DataFrame:
    key = "server.servlet.session.cookie.secure"
    return _out(_spring(files, key.replace(".", r"\.")).where(F.lower(F.trim("value")) == "false"), "ZS-CFG-006", "spring", "medium", key, F.col("value"))


def _line_rule(files: DataFrame, where: Column, rx: str, rule: str, framework: str, key: str, value: str) -> DataFrame:
    return _out(lines(files.where(where)).where(F.col("line").rlike(rx)), rule, framework, "medium", key, value, "line_no")


def aspnet_errors(files: DataFrame) -> DataFrame:
    return _line_rule(files, file_named(r"\Aweb\.config\z"), rf'(?iu)<customErrors\b[^>]*\bmode{_IS}"off"', "ZS-CFG-007", "aspnet", "customErrors", "Off")


def aspnet_browse(files: DataFrame) -> DataFrame:
    return _line_rule(files, file_named(r"\Aweb\.config\z"), rf'(?iu)<directoryBrowse\b[^>]*\benabled{_IS}"true"', "ZS-CFG-008", "aspnet", "directoryBrowse", "true")


def laravel_session(files: DataFrame) -> DataFrame:
    at = _LOW_PATH().endswith("config/session.php")
    a = _line_rule(files, at, r"(?iu)'secure'\s*=>\s*(?:false\b|env\((?:[^)]*,)\s*false\s*\))", "ZS-CFG-009", "laravel", "secure", "false")
    return a.unionByName(_line_rule(files, at, r"(?iu)'http_only'\s*=>\s*false\b", "ZS-CFG-009", "laravel", "http_only", "false"))


def csrf_except(files: DataFrame) -> DataFrame:
    rx = rf"(?isu)(protected\s+[$]except{_IS}\[(.*?)\]\s*;)"
    use = files.where(file_named(r"\Averifycsrftoken\.php\z") & F.col("content").rlike(rx)).select("path", "content", F.regexp_extract("content", rx, 1).alias("whole"), F.regexp_extract("content", rx, 2).alias("body"))
    use = use.where(F.col("body").rlike("[\"']")).withColumn("line", F.expr(r"size(split(substring_index(content, whole, 1), '\n'))"))
    return _out(use, "ZS-CFG-010", "laravel", "high", "$except", "")


def php_ini(files: DataFrame) -> DataFrame:
    rx = r"(?iu)\A\s*session\.cookie_(secure|httponly)\s*=\s*(?:off|false|0)\s*\z"
    hit = lines(files.where(file_named(r"\Aphp\.ini\z"))).where(F.col("line").rlike(rx))
    return _out(hit, "ZS-CFG-011", "php", "medium", F.concat(F.lit("session.cookie_"), F.lower(F.regexp_extract("line", rx, 1))), "off", "line_no")


CHECKS = (django_debug, express_without_helmet, wildcard_cors, laravel_debug, spring_actuator, spring_cookie, aspnet_errors, aspnet_browse, laravel_session, csrf_except, php_ini)


def config_findings(files: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (c(files) for c in CHECKS))
