"""The comparison job: any number of baseline and incident bundles of a workspace at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlog.operators import compare
from fernlog.storage import small

#: Pairs that may be broadcast.
BROADCAST_PAIRS = 1_000_000


def compare_bundles(tables: dict[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """Comparisons of the bundles of ``pairs`` (pair, baseline, incident): long tables by pair.

    ``tables`` are a workspace's artifacts, findings and timeline. Gives counts, severity_delta, artifact_diff, new_findings,
    resolved_findings and unchanged_rules. A bundle may stand in any number of pairs, on either side.
    """
    sides = pairs.select("pair", F.lit("baseline").alias("side"), F.col("baseline").alias("_b")).unionByName(pairs.select("pair", F.lit("incident").alias("side"), F.col("incident").alias("_b")))
    sides = small(sides, 2 * BROADCAST_PAIRS)

    def of(name: str, *columns: str) -> DataFrame:
        rows = tables[name].select("bundle_id", *columns)
        return rows.join(sides, F.col("bundle_id") == F.col("_b")).drop("_b", "bundle_id")

    files, events = of("artifacts", "path", "sha256"), of("timeline")
    findings = of("findings", "id", "rule_id", "component", "title", "severity")
    one = lambda df, side: df.where(F.col("side") == side).drop("side")
    a, b = one(findings, "baseline"), one(findings, "incident")
    return {
        "counts": compare.comparison_counts(files, findings, events),
        "severity_delta": compare.severity_delta(a, b),
        "artifact_diff": compare.artifact_diff(one(files, "baseline"), one(files, "incident")),
        "new_findings": compare.new_findings(a, b),
        "resolved_findings": compare.resolved_findings(a, b),
        "unchanged_rules": compare.unchanged_rules(a, b),
    }
