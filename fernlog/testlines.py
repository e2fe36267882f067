"""Log lines, requests, artifacts and sessions derived from the given tables, in the same way in Spark and in SQL.

The tables hold no diagnostic data, so that queries and benchmarks derive it: its size follows theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernlog.storage import exists, stored

# files of 100 lines, three to a bundle, so that their number grows with the table; line numbers are arithmetic
_FILE, _BUNDLE = 100, 300

_MESSAGE = """CASE CAST(event_id % 16 AS INT)
 WHEN 0 THEN {ts} || ' INFO service=api request_id=req-' || event_id || ' request started'
 WHEN 1 THEN {ts} || ' ERROR service=api request_id=req-' || event_id || ' database connection refused user=' || (1000 + user_id)
 WHEN 2 THEN {ts} || ' WARN service=web trace_id=tr-' || event_id || ' upstream timeout after ' || (5000 + event_id % 3) || 'ms'
 WHEN 3 THEN {ts} || ' ERROR service=db postgres query failed code ' || (100 + event_id % 5)
 WHEN 4 THEN {ts} || ' INFO login email=user' || user_id || '@example.test from 192.0.2.' || (event_id % 250)
 WHEN 5 THEN {ts} || ' CRITICAL service=worker java.lang.OutOfMemoryError heap id ' || event_id
 WHEN 6 THEN {ts} || ' ERROR authentication failed password=secret-' || user_id || ' status=401'
 WHEN 7 THEN {ts} || ' DEBUG cache warm key ' || event_id
 WHEN 8 THEN {ts} || ' ERROR dial tcp lookup db' || (event_id % 4) || '.example.test: no such host'
 WHEN 9 THEN {ts} || ' INFO Authorization: Bearer token-value-' || (100000000 + event_id)
 WHEN 10 THEN {ts} || ' ERROR service=api correlation_id=c' || (event_id % 40) || ' deadline exceeded calling 198.51.100.' || (user_id % 250)
 WHEN 11 THEN {ts} || ' 127.0.0.1 - - "GET /x/' || event_id || ' HTTP/1.1" ' || (CASE WHEN event_id % 5 = 0 THEN 503 ELSE 200 END) || ' 12'
 WHEN 12 THEN '{{"timestamp": "' || {ts} || '", "level": "' || (CASE event_id % 3 WHEN 0 THEN 'fatal' WHEN 1 THEN 'ERR' ELSE 'warn' END) || '", "service": "svc' || (event_id % 5) || '", "message": "mysql error ' || event_id || '", "requestId": "j-' || (event_id % 7) || '"}}'
 WHEN 13 THEN '{{"time": "' || {ts} || '", "ts": 5, "level": 3, "severity": "critical", "component": "", "msg": "out of memory", "trace_id": "j' || (event_id % 9) || '"}}'
 WHEN 14 THEN {ts} || ' ERROR service=raw binary ' || {nul} || ' timed out'
 ELSE {ts} || ' ERROR service=long connection reset ' || repeat('segment ', 45) || event_id
END"""

_PLATFORM = """CASE CAST(event_id % 14 AS INT)
 WHEN 0 THEN 'PHP Fatal error: Uncaught Exception in /srv/a.php:' || event_id
 WHEN 1 THEN 'Allowed memory size of ' || event_id || ' bytes exhausted'
 WHEN 2 THEN 'Maximum execution time of 30 seconds exceeded'
 WHEN 3 THEN 'WARNING: [pool www] seems busy ' || event_id
 WHEN 4 THEN 'upstream timed out (110) while reading ' || event_id
 WHEN 5 THEN 'open() failed (13: Permission denied)'
 WHEN 6 THEN '10.0.0.1 - - "GET /p/' || event_id || ' HTTP/1.1" 50' || (event_id % 4) || ' 7'
 WHEN 7 THEN '   java.lang.Thread.State: BLOCKED (on object monitor)'
 WHEN 8 THEN '   java.lang.Thread.State: RUNNABLE'
 WHEN 9 THEN '[gc,start] Pause Young ' || (event_id % 3000) || '.5ms'
 WHEN 10 THEN CASE WHEN user_id % 3 = 0 THEN 'Found one Java-level deadlock:' ELSE 'no locks' END
 WHEN 11 THEN CASE WHEN user_id % 5 = 0 THEN 'java.lang.OutOfMemoryError: Java heap space' ELSE '   java.lang.Thread.State: WAITING (parking)' END
 WHEN 12 THEN 'Application threads were stopped for ' || (event_id % 1900) || 'ms'
 ELSE 'plain line ' || event_id
END"""


def _stamp(seconds: str, spark: bool) -> str:
    if spark:
        return f"date_format(timestampadd(SECOND, CAST({seconds} AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    return f"strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds({seconds}), '%Y-%m-%dT%H:%M:%SZ')"


def _group(spark: bool, event: str = "event_id") -> tuple[str, str, str]:
    """Bundle and file number of an event, and its place in the file."""
    of = "DIV" if spark else "//"
    return f"CAST({event} {of} {_BUNDLE} AS BIGINT)", f"CAST({event} {of} {_FILE} AS BIGINT)", f"CAST({event} % {_FILE} AS BIGINT)"


def _lines(message: str, spark: bool) -> str:
    bundle, file, at = _group(spark)
    text = message.format(ts=_stamp("event_id * 5", spark), nul="char(0)" if spark else "chr(0)")
    return f"""SELECT 'b' || {bundle} AS bundle_id, 'logs/svc' || {file} || '.log' AS artifact, {at} + 1 AS line_no,
       {text} AS line FROM events"""


_HAR = """SELECT 'b' || {bundle} AS bundle_id, 'network/u' || {file} || '.har' AS artifact, {at} AS entry,
       {ts} AS started, CAST(e.value * 100 AS DOUBLE) AS time_ms, CASE WHEN e.event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
       CASE WHEN e.event_id % 17 = 0 THEN 'not a url' WHEN e.event_id % 17 = 5 THEN 'https://u:p@Api.Example.test:8443/a b?k=1#f' WHEN e.event_id % 17 = 9 THEN '::bad' ELSE p.url END AS url,
       CAST(CASE e.event_id % 7 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN 302 ELSE 200 END AS INT) AS status,
       CAST(e.event_id % 500 - 100 AS BIGINT) AS body_size, CAST(e.event_id % 900 AS BIGINT) AS content_size,
       CASE WHEN e.event_id % 4 = 0 THEN 'Authorization' WHEN e.event_id % 4 = 1 THEN 'Cookie' ELSE 'Accept' END AS header_name,
       CASE WHEN e.event_id % 4 = 0 THEN 'Bearer value-' || (100000000000 + e.event_id) ELSE 'user' || e.user_id || '@example.test' END AS header_value,
       e.event_id % 6 = 0 AS has_body
FROM (SELECT *, event_id % (SELECT max(page_id) + 1 FROM pages) AS page FROM events) e JOIN pages p ON p.page_id = e.page"""

# Names and first content of artifacts, so that every type occurs; the number in a path makes it unique.
_KINDS = [
    ("config/app.env", "A=1"), ("logs/php/error.log", "PHP notice"), ("nginx/access.log", "get"), ("k8s/pod.yaml", "apiVersion: v1 kind: Pod"), ("dump.HPROF", "JAVA PROFILE"),
    ("netstat.txt", "tcp"), ("events.evtx", "ElfFile"), ("data.json", '{"timestamp": 1, "severity": "x"}'), ("core.bin", "a{nul}b"), ("inner.zip", "PK{03}{04}"), ("trace.har", "{"),
    ("export.json", '{"log": {"entries": [{"startedDateTime": 1}]}}'), ("system.xml", "<Event><System/></Event>"), ("docker-inspect.json", "[]"), ("gc.log", "pause"), ("jvm.txt", "[gc,start] x"),
    ("thread-dump.txt", "   java.lang.Thread.State: RUNNABLE"), ("proxy.txt", '10.0.0.1 - - [now] "GET /x HTTP/1.1" 200'), ("nginx/error.log", "bad"), ("apache/access.log", "get"), ("apache/error.log", "bad"),
    ("package.json", "{}"), ("values.yml", "a: 1"), ("app.toml", "a = 1"), ("conf.json", "{}"), ("service.log", "2024-01-01 ERROR x"), ("notes", "plain words"), ("old.xml", "<x/>"), ("late.bin", "{long}{nul}"), ("app.csproj", "<Project/>"),
]


def _artifacts(spark: bool) -> str:
    chr_ = "char" if spark else "chr"
    codes = {"{nul}": f"{chr_}(0)", "{03}": f"{chr_}(3)", "{04}": f"{chr_}(4)", "{long}": "repeat('x', 9000)"}

    def text(content: str) -> str:
        parts = "'" + content.replace("'", "''") + "'"
        for mark, code in codes.items():
            parts = parts.replace(mark, f"' || {code} || '")
        return parts

    name = " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(_KINDS))
    content = " ".join(f"WHEN {i} THEN {text(c)}" for i, (_, c) in enumerate(_KINDS))
    return f"""SELECT 'b' || (o_orderkey % 5) AS bundle_id, CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'incident' END AS side,
       CASE CAST(n % {len(_KINDS)} AS INT) {name} END AS name, 'd' || (o_custkey % 40) AS folder, n, CAST(o_custkey AS BIGINT) AS c,
       CASE CAST(n % {len(_KINDS)} AS INT) {content} END || ' ' || o_orderpriority || '/' || (o_orderkey % 3) AS content FROM (SELECT *, CAST(o_orderkey AS BIGINT) AS n FROM orders) o"""


# sizes are scaled so that the limits of size and of the sum of sizes trip
_ENTRIES = """SELECT CAST(l_orderkey AS BIGINT) AS bundle_id, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS BIGINT) AS entry_no,
       CASE CAST((l_orderkey + l_linenumber) % 23 AS INT) WHEN 3 THEN '../etc/passwd' WHEN 7 THEN '/abs/file' WHEN 11 THEN 'C:\\\\x\\\\y' WHEN 13 THEN 'a//b/./same.log'
            WHEN 14 THEN 'a/b/SAME.log' WHEN 19 THEN 'x/../..' ELSE 'logs/f' || l_linenumber || '.log' END AS name,
       CASE CAST(l_suppkey % 31 AS INT) WHEN 5 THEN 'symlink' WHEN 6 THEN 'directory' ELSE 'file' END AS mode,
       CAST(floor(floor(l_extendedprice) * 12000 / (40 + l_partkey % 240)) AS BIGINT) AS compressed, CAST(floor(l_extendedprice) AS BIGINT) * 12000 AS size FROM lineitem"""

_SESSIONS = """SELECT CAST(o_orderkey AS BIGINT) AS session_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
       CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_custkey AS BIGINT) AS owner FROM orders"""


def _har(spark: bool) -> str:
    bundle, file, at = _group(spark, "e.event_id")
    return _HAR.format(bundle=bundle, file=file, at=at, ts=_stamp("e.event_id", spark))


#: DuckDB SQL of the derived tables, for WITH clauses.
SQL = {
    "lines": _lines(_MESSAGE, False),
    "platform_lines": _lines("{ts} || ' ' || " + _PLATFORM, False),
    "har": _har(False),
    "artifacts": _artifacts(False),
    "entries": _ENTRIES.replace("\\\\", "\\"),
    "sessions": _SESSIONS,
}
_SPARK = {
    "lines": _lines(_MESSAGE, True),
    "platform_lines": _lines("{ts} || ' ' || " + _PLATFORM, True),
    "har": _har(True),
    "artifacts": _artifacts(True),
    "entries": _ENTRIES,
    "sessions": _SESSIONS,
}
_NEEDS = {"lines": ["events"], "platform_lines": ["events"], "har": ["events", "pages"], "artifacts": ["orders"], "entries": ["lineitem"], "sessions": ["orders"]}


_written: dict[tuple[str, str, str], DataFrame] = {}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables as a DataFrame.

    It is written once a session, in as many parts as there are cores (entries: as their window leaves them, which has shuffled them already), and
    read from then on, as logs would be: queries work on stored lines, and their expressions aren't merged with those that make the lines.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written or not exists(spark, _written[key]._scratch):
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _NEEDS[name]}
        query = _SPARK[name].replace("{", "{{").replace("}", "}}")
        for t in tables:
            query = query.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        rows = spark.sql(query, **tables)
        _written[key] = stored(rows if name == "entries" else rows.repartition(spark.sparkContext.defaultParallelism), name)
    return _written[key]
