"""Comparison of baseline and incident: artifacts, findings, severities.

Both sides have ``pair`` (the comparison they belong to), so that any number of comparisons runs at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlog.functions import scalars as S

KEY = ["pair", "rule_id", "component", "title"]


def artifact_diff(baseline: DataFrame, incident: DataFrame) -> DataFrame:
    """Paths that were added or removed, or whose hash changed; ``path`` is unique on each side of a pair."""
    a = baseline.select("pair", "path", F.col("sha256").alias("baseline_sha256"))
    b = incident.select("pair", "path", F.col("sha256").alias("incident_sha256"))
    change = (
        F.when(F.col("baseline_sha256").isNull(), "added").when(F.col("incident_sha256").isNull(), "removed").when(F.col("baseline_sha256") != F.col("incident_sha256"), "changed")
    )
    return a.join(b, ["pair", "path"], "full_outer").withColumn("change", change).where(F.col("change").isNotNull())


def added_artifacts(baseline: DataFrame, incident: DataFrame) -> DataFrame:
    return incident.select("pair", "path").join(baseline.select("pair", "path"), ["pair", "path"], "left_anti")


def removed_artifacts(baseline: DataFrame, incident: DataFrame) -> DataFrame:
    return added_artifacts(incident, baseline)


def last_by_key(findings: DataFrame) -> DataFrame:
    """The last finding in stored order (most severe first, then id) of each key; a null component counts as an empty one."""
    keyed = findings.withColumn("component", F.coalesce("component", F.lit("")))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(S.severity_rank(F.col("severity")).asc(), F.col("id").desc()))
    return keyed.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def new_findings(baseline: DataFrame, incident: DataFrame) -> DataFrame:
    """Findings whose key only the incident has."""
    return last_by_key(incident).join(baseline.withColumn("component", F.coalesce("component", F.lit(""))).select(*KEY), KEY, "left_anti")


def resolved_findings(baseline: DataFrame, incident: DataFrame) -> DataFrame:
    """Findings whose key only the baseline has."""
    return new_findings(incident, baseline)


def unchanged_rules(baseline: DataFrame, incident: DataFrame) -> DataFrame:
    """Rules that a key on both sides has."""
    keys = [f.withColumn("component", F.coalesce("component", F.lit(""))).select(*KEY) for f in (incident, baseline)]
    return keys[0].join(keys[1], KEY, "left_semi").select("pair", "rule_id").distinct()


def severity_delta(baseline: DataFrame, incident: DataFrame) -> DataFrame:
    """Incident less baseline findings by severity; zeros stay."""
    both = incident.select("pair", "severity", F.lit(1).alias("d")).unionByName(baseline.select("pair", "severity", F.lit(-1).alias("d")))
    return both.groupBy("pair", "severity").agg(F.sum("d").alias("delta"))


def comparison_counts(artifacts: DataFrame, findings: DataFrame, events: DataFrame) -> DataFrame:
    """Artifacts, findings and events on either side of each pair, before any key is made unique. Inputs have pair and side."""
    rows = [t.select("pair", "side", F.lit(name).alias("what")) for name, t in (("artifacts", artifacts), ("findings", findings), ("events", events))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("pair", "side", "what").agg(F.count("*").alias("n"))
