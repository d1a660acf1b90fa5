"""Running contributor totals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lintlake.operators.team import contributor_stats


def running_contributor_stats(commits: DataFrame) -> DataFrame:
    """The batch aggregation on a stream of ``commits(author, commit_id, ts, issues)``.

    Use update mode: one state row per author, changed rows are emitted.
    """
    return contributor_stats(commits)
