"""Secret detectors: a regular expression a line, an entropy floor, redacted findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosec.functions.text import digest, entropy, redact
from argosec.sources.walk import lines
from argosec.storage import spread

_Q = "[\"']"
# rule, name, regular expression with the secret in group 1, entropy floor, severity
DETECTORS = (
    ("ZS-SEC-001", "AWS access key", r"(?:\A|[^0-9A-Z])(AKIA[A-Z0-9]{16})(?:\z|[^0-9A-Z])", None, "critical"),
    ("ZS-SEC-002", "GitHub token", r"(gh[po]_[0-9A-Za-z]{36}|github_pat_\w{82})", None, "critical"),
    ("ZS-SEC-003", "Generic API key", rf"(?iu)api[-_]?key\s*[=:]\s*{_Q}?([-\w]{{20,64}}){_Q}?", 3.0, "high"),
    ("ZS-SEC-004", "Hard-coded password", rf"(?iu)(?:pwd|passw(?:or)?d)\s*[=:]\s*{_Q}([^\"']{{8,}}){_Q}", 3.0, "high"),
    ("ZS-SEC-005", "Private key", r"(-{5}BEGIN (?:\w+ )?PRIVATE KEY-{5})", None, "critical"),
)


def may_match(line: Column) -> Column:
    """Whether a line holds a word without which no detector matches; plain searches that most lines fail, before any regular expression."""
    low = F.translate(F.lower(line), "\u017f\u0131", "si")  # the letters that fold to s and i without being lowered to them
    words = [low.contains(w) for w in ("api", "pwd", "passw")] + [line.contains(w) for w in ("AKIA", "ghp_", "gho_", "github_pat_", "-----BEGIN ")]
    return reduce(Column.__or__, words)


def matches(line: Column) -> Column:
    """Array of (rule_id, rule_name, secret, floor, severity): the first match of each detector in a line, entropy not yet looked at."""
    found = [F.struct(F.lit(rule).alias("rule_id"), F.lit(name).alias("rule_name"), F.regexp_extract(line, rx, 1).alias("secret"), F.lit(floor).cast("double").alias("floor"), F.lit(severity).alias("severity")) for rule, name, rx, floor, severity in DETECTORS]
    return F.filter(F.array(*found), lambda x: x["secret"] != "")  # group 1 of a match is never empty


def fingerprint(rule: Column, secret: Column) -> Column:
    """sha256 of the detector and the hash of the secret's first 32 characters; the file is no part of it."""
    return digest(rule, F.sha2(F.substring(secret, 1, 32), 256))


def secrets_of_lines(rows: DataFrame) -> DataFrame:
    """Findings of (path, line_no, line); the secret itself does not leave this function."""
    some = rows.where(may_match(F.col("line")))
    hits = some.select("path", "line_no", F.explode(matches(F.col("line"))).alias("hit")).select("path", "line_no", "hit.*")
    hits = hits.withColumn("entropy", entropy(F.col("secret"))).where(F.col("floor").isNull() | (F.col("entropy") >= F.col("floor")))
    return hits.select("rule_id", "rule_name", "severity", "path", "line_no", "entropy", redact(F.col("secret")).alias("redacted"), fingerprint(F.col("rule_id"), F.col("secret")).alias("fingerprint"))


def secrets(files: DataFrame) -> DataFrame:
    return secrets_of_lines(lines(spread(files.where("not is_binary") if "is_binary" in files.columns else files)))
