"""The rule record and the table of all rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """One pattern.

    ``anchors``: lower-case literals of which every hit contains at least one;
    a cheap substring test on the lower-cased text then decides whether the
    regex has to run at all. Empty means the regex always runs.
    ``probe``: a pattern that hits the same texts as ``pattern`` with less
    backtracking; it decides whether a file is hit, ``pattern`` finds the hits.
    ``shortest``: characters of the shortest hit; shorter texts meet no regex.
    ``kind``: ``regex`` (every hit), ``first`` (first hit only), ``threshold``
    (one hit at 1:1 once the count reaches ``threshold``), ``blank_run`` and
    ``nesting`` (computed from lines and brackets).
    ``message`` may use {match}, {count} and {length}.
    """

    engine: str
    rule: str
    pattern: str
    flags: str
    severity: str
    category: str
    message: str
    anchors: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    sub_category: str | None = None
    suggestion: str | None = None
    auto_fixable: bool = False
    kind: str = "regex"
    threshold: int = 0
    probe: str | None = None
    shortest: int = 0
    metadata: dict = field(default_factory=dict)


RULE_SCHEMA = T.StructType(
    [
        T.StructField("engine", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("flags", T.StringType()),
        T.StructField("languages", T.ArrayType(T.StringType())),
        T.StructField("severity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("sub_category", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("suggestion", T.StringType()),
        T.StructField("threshold", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def rules_table(spark, rules):
    """The catalogue as a DataFrame (a few hundred rows, fixed by the code)."""
    rows = [
        (
            r.engine, r.rule, r.pattern, r.flags, list(r.languages), r.severity, r.category,
            r.sub_category, r.message, r.suggestion, r.threshold, r.kind, dict(r.metadata),
        )
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)
