"""The sanitising job: artifacts of many exports to redacted texts with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlog.operators.inventory import sanitizable
from fernlog.operators.sanitize import pseudonymize
from fernlog.sources.store import write_sanitized
from fernlog.storage import discard, stored

PROFILES = ("standard", "strict")


def sanitized(artifacts: DataFrame, profile: str = "standard") -> DataFrame:
    """Each artifact's state: export, path, source_sha256, status, reason, text, replacements.

    ``artifacts`` has export, path (unique in it) and content. What is too large or binary is left out with the reason;
    the other texts are redacted, with pseudonyms that are the same all over an export.
    """
    if profile not in PROFILES:
        raise ValueError(f"unsupported redaction profile {profile!r}")
    state = sanitizable(artifacts).withColumn("source_sha256", F.sha2("content", 256))
    texts = state.where("status = 'sanitized'").select("export", "path", F.col("content").cast("string").alias("text"))
    done = pseudonymize(texts, profile)
    return state.select("export", "path", "source_sha256", "status", "reason").join(done, ["export", "path"], "left")


def sanitize_export(artifacts: DataFrame, output: str, profile: str = "standard") -> None:
    """``sanitized`` written to ``output`` with its manifest, published when it is complete."""
    done = stored(sanitized(artifacts, profile), "sanitized")
    write_sanitized(done, output, profile)
    discard(done)
