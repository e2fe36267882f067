"""Artifacts: type, hash, routing, audit of archive entries, analyzers."""

from __future__ import annotations

import unicodedata
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlog.patterns import LOG_TYPES, MANY_FINDINGS, NESTED, NO_HAR, NO_LOGS, java
from fernlog.storage import small

#: Analyzers and types that may be broadcast.
BROADCAST_ANALYZERS = 10_000


@dataclass(frozen=True)
class Limits:
    """What a bundle may hold."""

    files: int = 100_000
    total_bytes: int = 5 << 30
    file_bytes: int = 1 << 30
    ratio: int = 250
    name_bytes: int = 512
    events: int = 100_000
    findings: int = 10_000

    def column(self) -> Column:
        """The limits as a map."""
        return F.create_map(*[x for k, v in asdict(self).items() for x in (F.lit(k), F.lit(v).cast("long"))])


# What network diagnostics are called, and package manifests.
NETWORK = ["ipconfig", "ifconfig", "ip-addr", "netstat", "traceroute", "tracert", "nslookup", "dig-output", "route"]
MANIFESTS = ["package.json", "composer.json", "pom.xml", "go.mod", "requirements.txt", "pyproject.toml"]
# Types under which the analyzers know what the classifier calls otherwise.
ALIASES = {"windows-event": "windows-event-xml", "windows-event-binary": "windows-evtx", "recognized-large-binary-artifact": "jvm-heap-dump"}


def _looked_at(artifacts: DataFrame) -> DataFrame:
    """Adds what the rules look at, each worked out once for a row: _low (path), _base, _raw (magic bytes), _head, _text."""
    low = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    out = artifacts.withColumns({"_low": low, "_raw": F.hex(F.substring("content", 1, 4)), "_head": F.substring("content", 1, 65_536)})
    text = F.coalesce(F.make_valid_utf8(F.col("_head").cast("string")), F.lit(""))
    return out.withColumns({"_base": F.element_at(F.split("_low", "/"), -1), "_text": F.regexp_replace(text, r"^\s+|\s+$", "")})


def _type() -> Column:
    """Type of an artifact from its path and first 64 KiB, by ordered rules: the first that fits decides.

    Fixed values: the types, what they are known by, and the order of the rules.
    """
    low, base, raw, head, text = (F.col(c) for c in ("_low", "_base", "_raw", "_head", "_text"))
    has = lambda *parts: _all(text.contains(p) for p in parts)
    named = lambda *parts: _all(low.contains(p) for p in parts)
    ends = low.endswith
    json_log = has('"timestamp"') & (has('"level"') | has('"severity"'))
    access = text.rlike(java(r'^\S+\s+\S+\s+\S+\s+\[[^]]+\]\s+"[A-Z]+\s+\S+\s+HTTP/').replace("[^]]", r"[^\]]"))
    readable = F.is_valid_utf8(head.cast("string")) & ~F.contains(head, F.lit(b"\x00"))
    return (
        F.when(raw.startswith("504B0304") | raw.startswith("1F8B"), "archive")
        .when(ends(".hprof"), "recognized-large-binary-artifact")
        .when(ends(".har") | has('"log"', '"entries"', '"startedDateTime"'), "har")
        .when(ends(".evtx"), "windows-event-binary")
        .when(ends(".xml") & has("<Event", "System"), "windows-event")
        .when((base == "docker-inspect.json") | named("docker_inspect"), "docker-inspect")
        .when(named("gc.log") | has("[gc,") | has("Full GC"), "jvm-gc-log")
        .when(named("thread") & has("java.lang.Thread.State"), "jvm-thread-dump")
        .when(named("php") & ends(".log"), "php-log")
        .when(named("nginx", "access") | access, "nginx-access")
        .when(named("nginx", "error"), "nginx-error")
        .when(named("apache", "access"), "apache-access")
        .when(named("apache", "error"), "apache-error")
        .when(ends(".env"), "env-config")
        .when(base.isin(MANIFESTS) | base.endswith(".csproj"), "package-manifest")
        .when((ends(".yaml") | ends(".yml")) & has("apiVersion:", "kind:"), "kubernetes-manifest")
        .when(ends(".yaml") | ends(".yml"), "yaml-config")
        .when(ends(".toml"), "toml-config")
        .when(ends(".json") & json_log, "json-log")
        .when(ends(".json"), "json-config")
        .when(base.rlike("|".join(NETWORK)), "network-diagnostic")
        .when(ends(".log") | ends(".txt"), "generic-log")
        .when(F.coalesce(readable, F.lit(True)), "unknown-text")
        .otherwise("unknown-binary")
    )


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def typed(artifacts: DataFrame) -> DataFrame:
    """``artifacts`` (path, content and others) with id (first 16 digits of the hash), type, sha256 and size: worked out where the bytes are."""
    rows = _looked_at(artifacts.withColumn("sha256", F.sha2("content", 256)))
    return rows.select(*artifacts.columns, F.substring("sha256", 1, 16).alias("id"), _type().alias("type"), "sha256", F.octet_length("content").cast("long").alias("size"))


def inventory(artifacts: DataFrame) -> DataFrame:
    """bundle_id, path, id, type, sha256, size of ``artifacts`` (bundle_id, path, content)."""
    return typed(artifacts.select("bundle_id", "path", "content")).drop("content")


def route(found: DataFrame) -> DataFrame:
    """Adds ``route``: what analyses an artifact of its type."""
    kind = F.col("type")
    return found.withColumn("route", F.when(kind.isin(LOG_TYPES), "log").when(kind == "har", "har").when(kind == "archive", "nested-archive").otherwise("privacy-only"))


def plan_analyzers(found: DataFrame, analyzers: DataFrame) -> DataFrame:
    """Which analyzer (name, supported array of types) runs on which artifact. Analyzers are broadcast as far as they are few."""
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    own = found.select("bundle_id", "path", F.coalesce(F.try_element_at(alias, F.col("type")), F.col("type")).alias("type"))
    return own.join(small(analyzers.select("name", F.explode("supported").alias("type")), BROADCAST_ANALYZERS), "type").select("bundle_id", "path", "type", "name")


def sanitizable(artifacts: DataFrame, largest: int = 64 << 20) -> DataFrame:
    """Adds ``status`` and ``reason``: text of at most 64 MiB is sanitised, anything else is left out."""
    binary = F.contains(F.substring("content", 1, 8192), F.lit(b"\x00"))
    big = F.octet_length("content") > largest
    reason = F.when(big, "artifact exceeds the 64 MiB sanitization limit").when(binary, "binary artifacts are excluded from sanitized exports")
    return artifacts.withColumns({"status": F.when(big | binary, "excluded").otherwise("sanitized"), "reason": reason})


def clean_path(raw: str | None, most: int = 512) -> tuple[str | None, str]:
    """The normalised path of an archive entry, and ok or why it is refused."""
    if not raw or "\0" in raw:
        return None, "unsafe-entry"
    name = unicodedata.normalize("NFC", raw.replace("\\", "/"))
    if len(name.encode("utf-8", "surrogatepass")) > most:
        return None, "limit-exceeded"
    if any(unicodedata.category(c) == "Cc" or c in "‪‫‭‮⁦⁧⁨⁩" for c in name):
        return None, "unsafe-entry"
    if name.startswith("/") or (len(name) > 1 and name[1] == ":" and name[0].isascii() and name[0].isalpha()):
        return None, "path-traversal"
    kept: list[str] = []
    for part in name.split("/"):
        if part in ("", "."):
            continue
        if part == ".." and kept and kept[-1] != "..":
            kept.pop()
        else:
            kept.append(part)
    if not kept or kept[0] == "..":
        return None, "path-traversal"
    return "/".join(kept), "ok"


def safe_path(col: Column, most: int = 512) -> Column:
    """``clean_path`` of a column: struct of path and verdict. A path of plain characters and parts is already clean."""
    plain = col.rlike(r"^(?![A-Za-z]:)(?!\.{0,2}/)[A-Za-z0-9_.\- +@=,]+(/(?!\.{0,2}(/|$))[A-Za-z0-9_.\- +@=,]+)*$") & ~col.isin(".", "..") & (F.octet_length(col) <= most)

    @F.arrow_udf("struct<path string, verdict string>")
    def of(names: pa.Array) -> pa.Array:
        found = [clean_path(n, most) for n in names.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["path", "verdict"])

    # Python only sees the others: a column function would run on every row whatever ``when`` says
    other = of(F.when(~F.coalesce(plain, F.lit(False)), col).otherwise(F.lit("")))
    return F.when(plain, F.struct(col.alias("path"), F.lit("ok").alias("verdict"))).otherwise(other)


def audit_entries(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Verdict on each bundle's archive: the code of its first bad entry in archive order, or ok, and its files and bytes.

    ``entries`` has bundle_id, entry_no, name, mode (file, directory or other), compressed, size.
    """
    rows = entries.where("mode != 'directory'").withColumn("_p", safe_path(F.col("name"), limits.name_bytes))
    # what a row tells by itself is a code before the shuffle, and all windows use one shuffle by bundle: those over all its files come first
    own = (
        F.when(F.col("mode") != "file", "unsafe-entry")
        .when((F.col("compressed") > 0) & (F.col("size") > F.col("compressed") * limits.ratio), "limit-exceeded")
        .when(F.col("_p.verdict") != "ok", F.col("_p.verdict"))
    )
    rows = rows.select("bundle_id", "entry_no", "size", F.lower("_p.path").alias("path"), own.alias("_own"))
    order = Window.partitionBy("bundle_id").orderBy("entry_no")
    rows = rows.withColumns({"files": F.row_number().over(order), "total": F.sum("size").over(order)})
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("bundle_id", "path").orderBy("entry_no")))
    code = (
        F.when(F.col("_own").isNotNull(), F.col("_own"))
        .when(F.col("copy") > 1, "unsafe-entry")
        .when((F.col("files") > limits.files) | (F.col("size") < 0) | (F.col("size") > limits.file_bytes) | (F.col("total") > limits.total_bytes), "limit-exceeded")
    )
    bad = F.when(code.isNotNull(), F.col("entry_no"))
    out = rows.groupBy("bundle_id").agg(F.min(bad).alias("bad_entry"), F.min_by(code, bad).alias("code"), F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return out.withColumn("code", F.coalesce("code", F.lit("ok")))


def bundle_warnings(routed: DataFrame, runs: DataFrame | None = None, capped: DataFrame | None = None) -> DataFrame:
    """Warnings of each bundle's manifest and the status of its analyzer run: bundle_id, artifacts, warnings, run_warnings, status.

    Warnings are, in this order: nested archives by path, no logs, no HTTP archive, capped findings (``capped`` has the
    bundle_ids), and the run's own. Only the run's own (``runs``: bundle_id, artifact, warning; in path order, each with
    the path in front where it is about a failed file) make the run one with warnings.
    """
    n = lambda r: F.count_if(F.col("route") == r)
    nested = F.when(F.col("route") == "nested-archive", F.concat(F.lit(NESTED[0]), "path", F.lit(NESTED[1])))
    by = routed.groupBy("bundle_id").agg(F.count("*").alias("artifacts"), n("log").alias("logs"), n("har").alias("hars"), F.sort_array(F.collect_list(nested)).alias("nested"))
    none = F.array().cast("array<string>")
    if runs is None:
        by = by.withColumn("run_warnings", none)
    else:
        own = F.transform(F.sort_array(F.collect_list(F.struct("artifact", "warning"))), lambda x: x["warning"])
        by = by.join(runs.groupBy("bundle_id").agg(own.alias("run_warnings")), "bundle_id", "left")
    by = by.withColumn("_capped", F.lit(False)) if capped is None else by.join(capped.select("bundle_id", F.lit(True).alias("_capped")), "bundle_id", "left")
    run = F.coalesce("run_warnings", none)
    notes = F.array_compact(F.array(F.when(F.col("logs") == 0, NO_LOGS), F.when(F.col("hars") == 0, NO_HAR), F.when(F.coalesce("_capped", F.lit(False)), MANY_FINDINGS)))
    status = F.when(F.size(run) > 0, "completed_with_warnings").otherwise("completed")
    return by.select("bundle_id", "artifacts", F.concat("nested", notes, run).alias("warnings"), run.alias("run_warnings"), status.alias("status"))


def sort_artifacts(artifacts: DataFrame) -> DataFrame:
    """By path components, the order of a walk through folders."""
    return artifacts.orderBy(F.split("path", "/"))
