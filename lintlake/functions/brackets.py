"""Bracket depth and cognitive complexity as folds over short token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, has_match, lines_of

# One alternative per literal kind; possessive, so long strings need no stack.
_LITERALS = (
    r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?'
    r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'?"
    r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"
    r"|//[^\n]*+"
    r"|/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
)
_BRACKETS = r"[{(\[\])}\n]"


def nesting_profile(text, skip_literals: bool) -> Column:
    """Struct (depth INT, line INT): deepest bracket level and where first reached.

    With ``skip_literals`` strings and comments are left out and the level may
    go below zero; without, every bracket counts and the level stops at zero.
    """
    pattern = f"{_LITERALS}|{_BRACKETS}" if skip_literals else _BRACKETS
    tokens = F.regexp_extract_all(col_of(text), F.lit(pattern), F.lit(0))
    start = F.struct(
        F.lit(0).alias("level"), F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(1).alias("line")
    )

    def step(acc, token):
        opens = token.isin("{", "(", "[")
        closes = token.isin("}", ")", "]")
        plain = F.regexp_replace(token, r"\\[\s\S]", "") if skip_literals else token
        breaks = F.length(token) - F.length(F.replace(token, F.lit("\n"), F.lit("")))
        if skip_literals:
            is_text = token.substr(1, 1).isin('"', "'", "`")
            breaks = F.when(
                is_text, F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
            ).otherwise(breaks)
        down = acc["level"] - 1 if skip_literals else F.greatest(acc["level"] - 1, F.lit(0))
        level = F.when(opens, acc["level"] + 1).when(closes, down).otherwise(acc["level"])
        deeper = level > acc["depth"]
        return F.struct(
            level.alias("level"),
            (acc["at"] + breaks).alias("at"),
            F.when(deeper, level).otherwise(acc["depth"]).alias("depth"),
            F.when(deeper, acc["at"]).otherwise(acc["line"]).alias("line"),
        )

    folded = F.aggregate(tokens, start, step)
    return F.struct(folded["depth"].alias("depth"), folded["line"].alias("line"))


#: Rounds in which innermost pairs are taken out before brackets are counted.
ROUNDS = 2


def may_nest(text, depth: int) -> Column:
    """Whether ``nesting_profile`` with ``skip_literals`` can reach a depth; false only where it cannot.

    Taking out every opening bracket that a closing one follows lowers the
    deepest level by one at most, so after ``ROUNDS`` times ``depth - ROUNDS``
    opening ones must be left. Costs a few passes over the text and no fold.
    """
    left = F.regexp_replace(col_of(text), _LITERALS + r"|[^{(\[\])}\"'`/]++|/", "")
    for _ in range(ROUNDS):
        left = F.regexp_replace(left, r"[{(\[][\])}]", "")
    return F.length(F.regexp_replace(left, r"[\])}]++", "")) >= depth - ROUNDS


def nesting_depth(text) -> Column:
    """INT: the depth of ``nesting_profile`` where every bracket counts, by a fold over runs of brackets."""
    brackets = F.regexp_replace(col_of(text), r"[^{(\[\])}]++", "")
    runs = F.regexp_extract_all(brackets, F.lit(r"[{(\[]++|[\])}]++"), F.lit(0))
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("depth"))

    def step(acc, run):
        up = run.substr(1, 1).isin("{", "(", "[")
        level = F.when(up, acc["level"] + F.length(run)).otherwise(F.greatest(acc["level"] - F.length(run), F.lit(0)))
        return F.struct(level.alias("level"), F.greatest(acc["depth"], level).alias("depth"))

    return F.aggregate(runs, start, step)["depth"]


# What adds to cognitive complexity, and what opens a level.
COGNITIVE_HITS = [
    r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcatch\b", r"\bexcept\b",
    r"\?\s*[^:]", r"&&", r"\|\|",
]
COGNITIVE_OPENERS = [r"\bif\b.*\{", r"\bfor\b.*\{", r"\bwhile\b.*\{", r"\btry\b.*\{", r"\bswitch\b.*\{"]


def cognitive_complexity(text) -> Column:
    """INT: per line, each hit kind adds one plus the current level."""
    summed = lambda line, patterns: sum(
        (has_match(line, p).cast("int") for p in patterns), F.lit(0)
    )
    # Lines without any of these can neither add nor change the level.
    relevant = F.filter(lines_of(text), lambda line: line.rlike(r"if|for|while|catch|except|try|switch|[?{}]|&&|\|\|"))
    facts = F.transform(
        relevant,
        lambda line: F.struct(
            summed(line, COGNITIVE_HITS).alias("hits"),
            summed(line, COGNITIVE_OPENERS).alias("up"),
            (
                F.length(F.replace(line, F.lit("}"), F.lit("")))
                - F.length(F.replace(line, F.lit("{"), F.lit("")))
            ).alias("net"),
        ),
    )
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("total"))

    def step(acc, x):
        level = acc["level"] + x["up"]
        return F.struct(
            F.when(x["net"] < 0, F.greatest(level + x["net"], F.lit(0))).otherwise(level).alias("level"),
            (acc["total"] + x["hits"] * (acc["level"] + 1)).alias("total"),
        )

    return F.aggregate(facts, start, step)["total"]
