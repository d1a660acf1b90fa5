"""Rule scans for SQL users, and detectors of their own beside the rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.scan import KEYS, describe_hits, hits_of_text, scan_rules
from lintlake.rules.model import Rule

COLUMNS = "engine string, rule string, category string, severity string, message string, line int, column int, match string"


def register_scan_code(spark: SparkSession, rules, name: str = "scan_code") -> None:
    """A temporary SQL table function ``name(text, language)``: a row per hit of the rules.

    ``SELECT path, h.* FROM files, LATERAL scan_code(text, language) h`` is one
    pass over ``files``: the call becomes a generator, without join or
    exchange. A null text has no hits; a null language only those of rules for
    any language. Rules about nesting need a fold over the whole file and are
    refused with ValueError.
    """
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING, language STRING) RETURNS TABLE({COLUMNS}) "
        f"RETURN SELECT h.* FROM (SELECT explode({hits_of_text(rules)}) AS h)"
    )


@dataclass(frozen=True)
class Detector:
    """A rule whose hits a function finds: texts to lists of (line, column, match) per text."""

    rule: Rule
    find: Callable[[pd.Series], pd.Series]


def scan_with(files: DataFrame, rules, detectors) -> DataFrame:
    """Findings of the rules and of the detectors, whose numbers follow those of the rules.

    All detectors run in one pass over batches of the files of their languages
    (a rule without languages sees every file). An error of a detector is
    raised, not hidden. Null texts are left out.
    """
    rules, detectors = list(rules), list(detectors)
    if not detectors:
        return scan_rules(files, rules)

    def run(batches):
        for batch in batches:
            parts = []
            for number, detector in enumerate(detectors):
                own = batch[batch["language"].isin(detector.rule.languages)] if detector.rule.languages else batch
                if own.empty:
                    continue
                hits = own[KEYS].assign(_rule=number, _hit=pd.Series(list(detector.find(own["text"])), index=own.index)).explode("_hit").dropna(subset=["_hit"])
                if not hits.empty:
                    places = pd.DataFrame(hits["_hit"].tolist(), columns=["line", "column", "match"], index=hits.index)
                    parts.append(pd.concat([hits[[*KEYS, "_rule"]], places], axis=1))
            if parts:
                yield pd.concat(parts)

    languages = {x for d in detectors for x in d.rule.languages}
    wanted = files.where("text IS NOT NULL")
    if all(d.rule.languages for d in detectors):
        wanted = wanted.where(F.col("language").isin(*languages))
    placed = wanted.select(*KEYS, "text").mapInPandas(
        run, "project string, path string, language string, _rule int, line int, column int, match string"
    )
    own = describe_hits(placed.withColumn("_number", F.lit(None).cast("int")), [d.rule for d in detectors])
    own = own.withColumn("rule_order", F.col("rule_order") + len(rules))
    return scan_rules(files, rules).unionByName(own) if rules else own
