"""Redaction of whole texts, with fixed labels or with pseudonyms that are the same all over an export."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlog import patterns as P
from fernlog.operators.logs import count_of, may_hold
from fernlog.ordering import numbered
from fernlog.patterns import java


def kinds_of(profile: str) -> list[tuple[str, str]]:
    return P.STRICT_KINDS if profile.lower() == "strict" else P.STANDARD_KINDS


def redact(text: Column, profile: str = "standard") -> Column:
    """Each match becomes its kind's label, kind after kind, so that later kinds see earlier labels.

    A kind is looked for only where its cheaper test finds something. The step is a function of an array's one element, so
    that a text which is used three times in it is worked out once.
    """
    for kind, pattern in kinds_of(profile):
        text = F.get(F.transform(F.array(text), _replacement(kind, pattern)), F.lit(0))
    return text


def _replacement(kind: str, pattern: str):
    return lambda t: F.when(may_hold(t, kind), F.regexp_replace(t, java(pattern), f"{kind.upper()}_REDACTED")).otherwise(t)


#: Python's engine with ASCII classes: its white space also has the vertical tab, which is taken out.
_COMPILED = {p: re.compile(p.replace(r"[\s\S]", "\0").replace(r"[^\s", r"[^\t\n\f\r ").replace(r"\s", r"[\t\n\f\r ]").replace("\0", r"[\s\S]"), re.ASCII) for _, p in P.STRICT_KINDS}


def _marked(text: str, profile: str) -> tuple[str, list[tuple[str, str, int]]]:
    """Text with a placeholder for each match, and the placeholders in the order in which the kinds found them."""
    found: list[tuple[str, str, int]] = []
    for kind, pattern in kinds_of(profile):

        def put(m: re.Match, kind: str = kind) -> str:
            digest = hashlib.sha256(m[0].encode()).hexdigest()[:32].upper()
            found.append((kind, digest, len(found)))
            return f"{kind.upper()}_{digest.translate(str.maketrans('0123456789', 'GHIJKLMNOP'))}"

        text = _COMPILED[pattern].sub(put, text)
    return text, found


def pseudonymize(artifacts: DataFrame, profile: str = "standard") -> DataFrame:
    """Redacted texts: path, text, replacements (map of kind to count). ``artifacts`` has export, path and text.

    A value gets the same label (KIND_001 and so on, longer from 1000 on) wherever it stands in an export; numbers follow the first appearance
    in the order of path components, then of the text. Values leave the tasks only as hashes, and these are dropped.
    """
    spec = "struct<text string, found array<struct<kind string, digest string, at int>>>"

    @F.arrow_udf(spec)
    def mark(texts: pa.Array) -> pa.Array:
        done = [_marked(t, profile) if t is not None else (None, []) for t in texts.to_pylist()]
        rows = [{"text": t, "found": [{"kind": k, "digest": d, "at": i} for k, d, i in f]} for t, f in done]
        kind = pa.struct([("text", pa.string()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("digest", pa.string()), ("at", pa.int32())])))])
        return pa.array(rows, kind)

    # exports may be null: they meet by a key that isn't
    key = F.coalesce(F.concat(F.lit("="), F.col("export").cast("string")), F.lit("")).alias("_e")
    marked = artifacts.select("export", key, "path", mark("text").alias("m")).select("export", "_e", "path", "m.text", "m.found")
    each = marked.select("_e", "path", F.explode("found").alias("f")).select("_e", "path", "f.kind", "f.digest", "f.at")
    first = each.groupBy("_e", "kind", "digest").agg(F.min(F.struct(F.split("path", "/").alias("parts"), "at")).alias("first"))
    first = numbered(first, ["_e", "kind"], ["first"])
    labels = first.select("_e", "kind", "digest", F.concat(F.upper("kind"), F.lit("_"), F.format_string("%03d", "number")).alias("label"))
    own = each.select("_e", "path", "kind", "digest").distinct().join(labels, ["_e", "kind", "digest"])
    holder = F.concat(F.upper("kind"), F.lit("_"), F.translate("digest", "0123456789", "GHIJKLMNOP"))
    own = own.groupBy("_e", "path").agg(F.map_from_entries(F.collect_list(F.struct(holder.alias("h"), "label"))).alias("labels"))

    # all placeholders have one shape: each is found by it and looked up
    holders = re.compile("(?:" + "|".join(k.upper() for k, _ in kinds_of(profile)) + ")_[A-P]{32}")

    @F.arrow_udf("string")
    def put(texts: pa.Array, labels: pa.Array) -> pa.Array:
        out = []
        for text, pairs in zip(texts.to_pylist(), labels.to_pylist(), strict=True):
            names = dict(pairs or [])
            out.append(text if not names or text is None else holders.sub(lambda m: names.get(m[0], m[0]), text))
        return pa.array(out, pa.string())

    # a value inside a longer match has no placeholder of its own any more, and is not counted twice
    per_kind = F.transform(F.array(*[F.lit(k) for k, _ in kinds_of(profile)]), lambda k: F.struct(k.alias("kind"), F.size(F.filter("found", lambda f: f["kind"] == k)).alias("n")))
    counts = F.map_from_entries(F.filter(per_kind, lambda x: x["n"] > 0))
    joined = marked.withColumn("replacements", counts).join(own, ["_e", "path"], "left")
    return joined.select("export", "path", put("text", "labels").alias("text"), "replacements")


def redaction_counts(rows: DataFrame, keys: list[str], text: str, profile: str = "standard") -> DataFrame:
    """Replacements by ``keys`` and kind when kinds are replaced one after the other."""
    steps, kinds = rows.select(*keys, F.col(text).alias("_t0")), kinds_of(profile)
    for i, (kind, pattern) in enumerate(kinds):  # a text is used twice, so that each step is worked out once
        now = F.col(f"_t{i}")
        size = count_of(now, kind, pattern)
        steps = steps.withColumn(f"_n{i}", size).withColumn(f"_t{i + 1}", F.when(F.col(f"_n{i}") > 0, F.regexp_replace(now, java(pattern), f"{kind.upper()}_REDACTED")).otherwise(now))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_n{i}").alias("n")) for i, (k, _) in enumerate(kinds)])
    found = steps.select(*keys, F.inline(F.filter(each, lambda x: x["n"] > 0)))
    return found.groupBy(*keys, "kind").agg(F.sum("n").alias("replacements"))


def redaction_summary(counts: DataFrame) -> DataFrame:
    """Replacements of an export by kind."""
    return counts.groupBy("kind").agg(F.sum("replacements").alias("replacements"))


__all__ = ["kinds_of", "pseudonymize", "redact", "redaction_counts", "redaction_summary"]
