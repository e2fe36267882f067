"""Column functions: severities, fingerprints, excerpts, timestamps, correlation ids, URLs, ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from fernlog import patterns as P
from fernlog.patterns import java

_SPACE = r"[\s\u0085\p{Z}]+"


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null without a match."""
    found = F.regexp_extract(col, java(pattern), group)
    return F.when(F.regexp_like(col, F.lit(java(pattern))), found)


def norm_severity_a(col: Column) -> Column:
    """warning, error, critical, debug, info, or an empty string; fatal counts as error."""
    low = F.lower(col)
    return (
        F.when(low.isin("warn", "warning"), "warning")
        .when(low.isin("err", "error", "fatal"), "error")
        .when(low.isin("critical", "crit"), "critical")
        .when(low == "debug", "debug")
        .when(low.isin("info", "information"), "info")
        .otherwise("")
    )


def detect_severity(col: Column) -> Column:
    """Severity by key words anywhere in a line, the gravest first; fatal counts as critical."""
    low = F.lower(col)
    return (
        F.when(low.contains("critical") | low.contains("fatal"), "critical")
        .when(low.contains("error") | low.contains("failed"), "error")
        .when(low.contains("warn"), "warning")
        .when(low.contains("debug"), "debug")
        .otherwise("info")
    )


def norm_level_b(col: Column) -> Column:
    """DEBUG, INFO, WARNING, ERROR, CRITICAL; anything else is INFO."""
    up = F.upper(col)
    return F.when(up.isin("WARN", "WARNING"), "WARNING").when(up.isin("FATAL", "CRITICAL"), "CRITICAL").when(up.isin("DEBUG", "ERROR"), up).otherwise("INFO")


def cut_bytes(col: Column, n: int) -> Column:
    """The first n bytes of the UTF-8 text; a character that is cut in two is replaced."""
    short = F.make_valid_utf8(F.substring(col.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(col) > n, short).otherwise(col)


def squeezed(col: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col, _SPACE, " "))


def _replaced(col: Column, steps: list[tuple[str, str]]) -> Column:
    """Replacements one after the other, and runs of Unicode white space as one space, none at the ends: by RE2 over whole Arrow batches, in
    time that grows with the text alone. A null stays null."""
    steps = [*steps, (r"[\t\n\x0b\f\r \x{85}\p{Z}]+", " ")]

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        for pattern, to in steps:
            texts = pc.replace_substring_regex(texts, pattern, to)
        return pc.ascii_trim(texts, " ")

    return of(F.make_valid_utf8(col))


def fingerprint(col: Column) -> Column:
    """The line without what varies: times, ids, addresses, long numbers; at most 240 bytes. Applying it again changes nothing."""
    steps = [(P.TIMESTAMP, "<TIMESTAMP>"), (P.VOLATILE_ID, r"\1\2<ID>"), (P.UUID, "<UUID>"), (P.IP, "<IP>"), (P.NUMBER, "<NUMBER>")]
    return cut_bytes(_replaced(col, steps), 240)


def normalize_message(col: Column) -> Column:
    """The second dialect's fingerprint: looser ids and addresses; at most 500 characters."""
    steps = [(P.TIMESTAMP, "<TIMESTAMP>"), (P.B_VOLATILE_ID, r"\1\2<ID>"), (P.B_UUID, "<UUID>"), (P.B_IP, "<IP>"), (P.NUMBER, "<NUMBER>")]
    return F.substring(_replaced(col, steps), 1, 500)


def matching(col: Column, patterns: list[str]) -> Column:
    """Numbers of the patterns (RE2's dialect) that a text matches, rising: all of them over whole Arrow batches. A null matches none."""

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        hits = np.zeros((len(texts), len(patterns)), bool)
        for k, p in enumerate(patterns):
            hits[:, k] = pc.match_substring_regex(texts, p).fill_null(False).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], hits.sum(axis=1).cumsum()])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(hits)[1], pa.int32()))

    return of(F.make_valid_utf8(col))


def excerpt(col: Column, n: int = 320, suffix: str = "…") -> Column:
    """The trimmed text, cut to n bytes and then marked."""
    trimmed = F.regexp_replace(col, r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$", "")
    return F.when(F.octet_length(trimmed) > n, F.concat(cut_bytes(trimmed, n), F.lit(suffix))).otherwise(trimmed)


def parse_ts_a(col: Column, tz: str = "UTC") -> Column:
    """RFC 3339 (T needs a zone), or the form with a space with or without one; without a zone it is in ``tz``. Else null."""
    clock = r"^\d{4}-\d{2}-\d{2}%s\d{2}:\d{2}:\d{2}(?:[.,]\d+)?%s$"
    zone = r"(?:Z|[+-]\d{2}:\d{2})"
    own = F.replace(col, F.lit(","), F.lit("."))
    with_zone = F.try_to_timestamp(F.regexp_replace(own, " ", "T"))
    local = F.to_utc_timestamp(F.try_to_timestamp(own), tz)
    return F.when(col.rlike(clock % ("[T ]", zone)), with_zone).when(col.rlike(clock % (" ", "")), local)


def parse_ts_b(col: Column) -> Column:
    """ISO 8601 with T or a space; without a zone it is in UTC. Else null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(col), r"^(\S+) ", "$1T"))


def parse_ts_har(col: Column) -> Column:
    """RFC 3339 only. Else null."""
    return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(col))


def first_string(variant: Column, keys: list[str]) -> Column:
    """The value of the first of the keys that holds a string; others are passed over, an empty string counts."""
    found = []
    for k in keys:
        path = f'$["{k}"]'
        is_text = F.schema_of_variant(F.try_variant_get(variant, path, "variant")) == "STRING"
        found.append(F.when(is_text, F.try_variant_get(variant, path, "string")))
    return F.coalesce(*found)


def _url(col: Column) -> dict[str, Column]:
    """Parts of a URL without its fragment: scheme, host (with port), path, and whether it can be parsed at all.

    A URL may lack a scheme or a host. It cannot be parsed with a control character, an empty scheme, a colon in the first
    segment of a path that nothing precedes, a broken percent escape, a port that is no number, or a host with a space.
    """
    whole = F.regexp_replace(F.coalesce(col, F.lit("")), r"#[\s\S]*$", "")
    scheme = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    rest = F.regexp_replace(F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), r"\?[\s\S]*$", "")
    opaque = (scheme != "") & ~rest.startswith("/")
    host = F.regexp_replace(F.regexp_extract(rest, r"^//([^/]*)", 1), r"^[^@]*@(?=[^@]*$)", "")
    path = F.when(opaque, "").otherwise(F.regexp_replace(rest, r"^//[^/]*", ""))
    bad = (
        col.rlike(r"[\x00-\x1f\x7f]")
        | whole.startswith(":")
        | ((scheme == "") & rest.rlike("^[^/]*:"))
        | path.rlike("%(?![0-9A-Fa-f]{2})")
        | ~host.rlike(r"^(\[[^\]]*\]|[^\[\]]*?)(:[0-9]*)?$")
        | host.rlike(r"^[^\[].*:[^0-9:][^:]*$")
        | host.rlike(r"[ \\^`{|}]")
    )
    return {"scheme": F.lower(scheme), "host": host, "path": path, "fine": ~F.coalesce(bad, F.lit(True))}


def url_host(col: Column) -> Column:
    """Host name of a URL without port, or ``unknown``."""
    u = _url(col)
    host = F.regexp_replace(F.regexp_replace(u["host"], r":[0-9]*$", ""), r"^\[|\]$", "")
    return F.when(u["fine"] & (host != ""), host).otherwise("unknown")


# What stays as it is in a path, though a query string would escape it.
_PLAIN = {"%24": "$", "%26": "&", "%2B": "+", "%2C": ",", "%2F": "/", "%3A": ":", "%3B": ";", "%3D": "=", "%40": "@", "%7E": "~"}


def safe_url(col: Column) -> Column:
    """scheme://host[:port]/path without user, query or fragment, or ``invalid-url``.

    A missing scheme or host is empty. A path with a character that has no place in one is escaped as a whole.
    """
    u = _url(col)
    escaped = F.replace(F.url_encode(F.url_decode(F.replace(u["path"], F.lit("+"), F.lit("%2B")))), F.lit("+"), F.lit("%20"))
    escaped = F.replace(escaped, F.lit("*"), F.lit("%2A"))
    for code, char in _PLAIN.items():
        escaped = F.replace(escaped, F.lit(code), F.lit(char))
    path = F.when(u["path"].rlike(r"^[A-Za-z0-9_.~!$&'()*+,;=:@\[\]%/\-]*$"), u["path"]).otherwise(escaped)
    return F.when(u["fine"], F.concat(u["scheme"], F.lit("://"), u["host"], path)).otherwise("invalid-url")


def correlation_id(col: Column) -> Column:
    return extract(col, P.CORRELATION)


def correlation_id_b(col: Column) -> Column:
    return extract(col, P.B_CORRELATION)


def severity_rank(col: Column) -> Column:
    """5 for critical to 1 for info and anything else."""
    return F.when(col == "critical", 5).when(col == "high", 4).when(col == "medium", 3).when(col == "low", 2).otherwise(1)


# Start and factor of the ids' hash.
_START, _FACTOR = 1469598103934665603, 1099511628211


def _hashes(joined: pa.Array) -> pa.Array:
    """``f-`` and 16 hex digits of a 64-bit xor-multiply over the bytes; the parts come joined by NUL."""
    out = []
    for value in joined.to_pylist():
        h = _START
        for byte in (value or "").encode():
            h = (h ^ byte) * _FACTOR & 0xFFFFFFFFFFFFFFFF
        out.append(f"f-{h:016x}")
    return pa.array(out, pa.string())


def finding_id(*parts: Column) -> Column:
    """Stable id of a finding; meant for grouped rows, since it runs in Python."""
    return F.arrow_udf(_hashes, "string")(F.concat_ws("\0", *parts))
