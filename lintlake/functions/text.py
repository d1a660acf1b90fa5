"""Native expressions over source text shared by all operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def java_regex(pattern: str, flags: str = "") -> str:
    """Pattern text for Spark with the reading the rules were written for.

    ``\\b`` becomes an ASCII word boundary, because on JDK 17 it follows
    Unicode letters while ``\\w`` does not, and only ``\\n`` ends a line.
    """
    out = []
    i = 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            before = pattern[i - 1] if i else ""
            escaped = i >= 2 and pattern[i - 2] == "\\"
            after = pattern[i + 2 : i + 3]
            after_two = pattern[i + 2 : i + 4]
            if re.match(r"\w", after) or after_two in (r"\w", r"\d"):
                out.append(r"(?<!\w)")
            elif re.match(r"\w", before) and (not escaped or before in "wd"):
                out.append(r"(?!\w)")
            else:
                out.append(_ASCII_BOUNDARY)
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            out.append(two[:1])
            i += 1
    return f"(?d{flags})" + "".join(out)


def sql_string(text: str) -> str:
    """SQL literal; big expressions are built as SQL text, one call each.

    ``${`` is written with an escape, or it would be read as a SQL variable.
    """
    text = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return "'" + text.replace("${", "$\\u007B") + "'"


def col_of(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def required_literal(pattern: str) -> str | None:
    """Literal that every hit of a plain word or operator pattern starts with.

    Only patterns of one alternative are read; for anything else there is none
    and the regex has to decide alone.
    """
    if re.search(r"(?<!\\)\|", pattern):
        return None
    word = re.match(r"(?:\\b)?([A-Za-z_]{2,})(?![\w?*{])", pattern)
    if word:
        return word.group(1)
    return {r"&&": "&&", r"\|\|": "||", r"\?\s*[^:]": "?", r"\?\.": "?.", r"\b\?\s*:": "?", r"\?.\b": "?"}.get(pattern)


def count_matches(text, pattern: str, flags: str = "") -> Column:
    """Number of regex hits as INT; a literal test first where the pattern has one."""
    c = col_of(text)
    count = F.regexp_count(c, F.lit(java_regex(pattern, flags)))
    literal = None if flags else required_literal(pattern)
    return F.when(F.contains(c, F.lit(literal)), count).otherwise(F.lit(0)) if literal else count


def has_match(text, pattern: str, flags: str = "") -> Column:
    c = col_of(text)
    found = c.rlike(java_regex(pattern, flags))
    literal = None if flags else required_literal(pattern)
    return F.contains(c, F.lit(literal)) & found if literal else found


def count_all(text, patterns, flags: str = "") -> Column:
    """Sum of the hit counts of several patterns."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + count_matches(text, pattern, flags)
    return total


def count_substring(text, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    c = col_of(text)
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def line_count(text) -> Column:
    """Lines as pieces between newlines, so an empty text has one."""
    return count_substring(text, "\n") + 1


def lines_of(text) -> Column:
    return F.split(col_of(text), "\n", -1)


def strip_ws(text) -> Column:
    """Trim ASCII white space, not only blanks."""
    return F.regexp_replace(col_of(text), r"^\s+|\s+$", "")


def kebab_case(text) -> Column:
    return F.lower(F.regexp_replace(col_of(text), "([a-z])([A-Z])", "$1-$2"))


def content_hash(text) -> Column:
    return F.md5(col_of(text).cast("binary"))


def finding_id(rule, path, line, column) -> Column:
    """md5 of ``rule:file:line:column`` with empty text and 0 for missing parts."""
    return F.md5(
        F.concat_ws(
            ":",
            F.coalesce(col_of(rule), F.lit("")),
            F.coalesce(col_of(path), F.lit("")),
            F.coalesce(col_of(line), F.lit(0)).cast("string"),
            F.coalesce(col_of(column), F.lit(0)).cast("string"),
        ).cast("binary")
    )


def snippet(text, line, around: int = 2) -> Column:
    """Lines around a 1-based line number, joined by newlines."""
    at = col_of(line)
    first = F.greatest(at - around, F.lit(1))
    last = F.least(at + around, line_count(text))
    inside = (at >= 1) & (at <= line_count(text))
    cut = F.slice(lines_of(text), first, F.greatest(last - first + 1, F.lit(0)))
    return F.when(inside, F.array_join(cut, "\n")).otherwise(F.lit(""))


def computed_once(df, keys, columns):
    """``keys`` plus costly ``columns``, each evaluated once per row.

    Filters on later columns would otherwise be pushed below this projection
    and repeat its expressions; a generator of one row holds them back.
    """
    return df.select(*keys, F.inline(F.array(F.struct(*columns))))
