"""All queries of the core."""

from __future__ import annotations

from daram.plans import extraction, mutations, parsing, relational, rules, text  # noqa: F401  (register their queries)
from daram.plans.registry import QUERIES, SQL
from daram.streaming import learning


def queries() -> dict:
    return QUERIES | {"stream_fold": learning.stream_fold, "running_counters": learning.running_counters}


def oracle_sql() -> dict[str, str]:
    return SQL | {
        "stream_fold": SQL["pattern_upsert_fold"],
        "running_counters": "SELECT method, count(*) AS attempts, count(*) FILTER (success) AS successes, count(*) FILTER (NOT coalesce(success, false)) AS failures FROM parse_result GROUP BY 1",
    }
