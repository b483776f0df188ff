"""Column functions and plan-time translations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters of a string, in bits, rounded to 6 digits."""
    chars = F.split(c, "")
    n = F.length(c).cast("double")
    part = F.transform(F.array_distinct(chars), lambda d: F.size(F.filter(chars, lambda x: x == d)) / n)
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.round(F.aggregate(part, F.lit(0.0), lambda a, p: a - p * F.log2(p)), 6))


def redact(c: Column) -> Column:
    return F.when(F.length(c) >= 4, F.concat(F.substring(c, 1, 4), F.lit("****"))).otherwise(F.lit("****"))


def digest(*parts: Column | str, length: int = 16) -> Column:
    """First hex digits of the sha256 of parts joined by a bar; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts)), 256), 1, length)


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def severity_rank(c: Column) -> Column:
    return F.coalesce(*(F.when(c == s, F.lit(i)) for i, s in enumerate(SEVERITIES)), F.lit(len(SEVERITIES)))


def base_name(c: Column) -> Column:
    return F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("/")), r"([^/]*)\z", 1)


def sarif_level(c: Column) -> Column:
    return F.when(c.isin("critical", "high"), "error").when(c == "medium", "warning").otherwise("note")


def classification_tag(c: Column) -> Column:
    """CWE-79 -> external/cwe/cwe-79; A03:2025 -> external/owasp/a03-2025."""
    low = F.lower(c)
    return F.when(low.startswith("cwe-"), F.concat(F.lit("external/cwe/"), low)).otherwise(F.concat(F.lit("external/owasp/"), F.replace(low, F.lit(":"), F.lit("-"))))


def glob_regex(pattern: str, double_star: bool = False) -> str:
    """A file-name pattern as an anchored regular expression; with double_star ** crosses directories and {a,b} is a choice."""
    out, i, deep = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if double_star and pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if double_star and pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j]
            out.append("[" + re.sub(r"([\\\[&])", r"\\\1", "^" + body[1:] if body[0] in "!^" else body) + "]")
            i = j
        elif double_star and c == "{" and "}" in pattern[i:]:
            out.append("(?:")
            deep += 1
        elif deep and c == ",":
            out.append("|")
        elif deep and c == "}":
            out.append(")")
            deep -= 1
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return r"\A" + "".join(out) + r"\z"
