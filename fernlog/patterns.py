"""Rules, patterns and word lists that results depend on.

Patterns are in the RE2 dialect, whose \\b, \\d, \\s are ASCII and whose dot stops at a line feed only; ``java`` gives the
same meaning to Java's engine, which Spark uses.
"""

from __future__ import annotations

import re

_BOUND = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_BEFORE_WORD, _AFTER_WORD = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def java(pattern: str) -> str:
    """The RE2 pattern for Java: ASCII word bounds, RE2's white space, and a dot that only excludes line feeds.

    A bound with a word character on a known side is the cheaper test of the other side.
    """
    out = pattern.replace(r"[\s\S]", "\0").replace(r"[^\s", "[^\\t\\n\\f\\r ").replace(r"\s", r"[\t\n\f\r ]").replace("\0", r"[\s\S]")
    out = re.sub(r"\\b(?=(?:\((?:\?:)?)*(?:[A-Za-z0-9]|\\d|\[0-9a-f\]))", lambda m: _BEFORE_WORD, out)
    if out.endswith(r"\b") and not out.endswith(r"_-]{8,}\b"):
        out = out[:-2] + _AFTER_WORD
    # a pattern that may start with a sign looks at the character before it looks at the bound
    out = re.sub(r"^\\b(?=\\\+\?\[1-9\])", lambda m: f"(?=[+1-9]){_BOUND}", out)
    return out.replace(r"\b", _BOUND).replace(".*", r"[^\n]*")


#: What a text must hold for a kind to match at all; a text without any of it is passed over. Parts as they are, or in
#: any case; else a pattern that is cheaper than the kind's.
NEEDLES = {"private_key": ["-----BEGIN "], "jwt": ["eyJ"], "email": ["@"], "connection_string": ["://"], "aws_access_key": ["AKIA", "ASIA"], "github_token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"]}
LOW_NEEDLES = {"bearer_token": ["bearer"], "basic_authorization": ["basic"], "password": ["passw", "pwd", "secret", "token", "apikey", "api_key", "api-key"], "home_path": ["/home/", "/users/", "\\users\\"]}
HINTS = {"ipv4": r"[0-9]\.[0-9]{1,3}\.[0-9]", "phone": r"[1-9][0-9 ()\-]{7}"}


# Log rules as id, title, severity, category, pattern.
LOG_RULES = [
    ("LOG_CONNECTION_REFUSED", "Repeated connection failures", "high", "connectivity", r"(?i)connection (?:refused|reset)|ECONNREFUSED"),
    ("LOG_DATABASE_ERROR", "Database errors observed", "high", "database", r"(?i)(?:database|postgres|mysql|sql).*(?:error|failed|unavailable|timeout)|too many connections"),
    ("LOG_AUTHENTICATION_FAILED", "Authentication failures observed", "medium", "authentication", r"(?i)authentication failed|invalid credentials|unauthorized|access denied|status[=: ]+401"),
    ("LOG_TIMEOUT", "Request or dependency timeouts observed", "medium", "latency", r"(?i)timed? out|deadline exceeded|upstream timeout|ETIMEDOUT"),
    ("LOG_OUT_OF_MEMORY", "Out-of-memory evidence observed", "high", "resources", r"(?i)outofmemoryerror|out of memory|oomkilled|cannot allocate memory"),
    ("LOG_DNS_FAILURE", "DNS resolution failures observed", "medium", "network", r"(?i)no such host|name or service not known|dns.*fail|NXDOMAIN"),
]

# What a finding of a rule says beside its counts, and what to look at next.
EXPLANATIONS = {
    "LOG_CONNECTION_REFUSED": "Evidence suggests that a component could not establish or retain a network connection. The destination availability and network path need verification.",
    "LOG_DATABASE_ERROR": "Database-related failures were observed in application output. This is evidence of a failed operation, not proof that the database itself is the root cause.",
    "LOG_AUTHENTICATION_FAILED": "Authentication or authorization failures were recorded and may indicate invalid credentials, expired tokens, or policy denial.",
    "LOG_TIMEOUT": "Operations exceeded a configured time boundary. Dependency latency and timeout configuration need verification.",
    "LOG_OUT_OF_MEMORY": "Explicit memory exhaustion evidence was observed. Confirm process and host memory conditions before attributing a root cause.",
    "LOG_DNS_FAILURE": "Name-resolution failures were observed. DNS availability, search domains, and the requested hostname need verification.",
    "HAR_HTTP_5XX": "Evidence shows HTTP 5xx responses. Application and upstream events around the same timestamps need verification.",
    "HAR_HTTP_4XX": "Evidence shows HTTP 4xx responses. Request validity and authorization policy need verification.",
    "HAR_SLOW_REQUESTS": "Requests exceeded the built-in two-second review threshold. Timing phases and server-side events should be compared.",
}
NEXT_STEPS = {
    "LOG_CONNECTION_REFUSED": ["Verify the destination service availability.", "Verify the configured host, port, and network path."],
    "LOG_DATABASE_ERROR": ["Check database health and connection capacity.", "Compare application and database timestamps."],
    "LOG_AUTHENTICATION_FAILED": ["Verify credential validity without exposing credentials.", "Inspect identity-provider and authorization-policy events."],
    "LOG_TIMEOUT": ["Compare timeout values with observed dependency latency.", "Inspect events immediately before the timeout window."],
    "LOG_OUT_OF_MEMORY": ["Inspect memory limits and utilization.", "Check allocation pressure before the event."],
    "LOG_DNS_FAILURE": ["Verify the hostname and DNS resolver configuration.", "Compare with network diagnostic artifacts."],
}
OTHER_SUMMARIES = {
    "web": ("Observed ", " matching record(s). The surrounding application and platform evidence needs review."),
    "windows": ("Observed ", " matching event(s). Event IDs are supporting evidence and do not establish root cause."),
    "JVM_HEAP_DUMP_RECOGNIZED": ("", "The large binary was not parsed. Use Eclipse MAT or another specialized offline heap analyzer."),
    "JVM_DEADLOCK_INDICATOR": ("", "The thread dump explicitly reports a possible Java-level deadlock."),
    "JVM_OUT_OF_MEMORY": ("", "The artifact contains explicit JVM memory-exhaustion evidence."),
    "JVM_BLOCKED_THREADS": ("Observed ", " BLOCKED thread states; lock ownership and surrounding stacks need review."),
    "JVM_LONG_GC_PAUSE": ("Observed ", " pause(s) over 1000 ms."),
}
# The rule's title and the excerpt that stands for the whole file.
JVM_TEXTS = {
    "JVM_HEAP_DUMP_RECOGNIZED": ("JVM heap dump recognized", "recognized_large_binary_artifact"),
    "JVM_DEADLOCK_INDICATOR": ("JVM deadlock indicator observed", "deadlock"),
    "JVM_OUT_OF_MEMORY": ("OutOfMemoryError evidence observed", "OutOfMemoryError"),
    "JVM_BLOCKED_THREADS": ("Multiple blocked JVM threads", "BLOCKED"),
    "JVM_LONG_GC_PAUSE": ("Long JVM garbage-collection pauses", "GC pause"),
}
# Findings of HTTP archives (id, title, severity, category), in the order in which a file has them.
HAR_RULES = [
    ("HAR_HTTP_5XX", "HTTP server errors observed", "high", "server-error"),
    ("HAR_HTTP_4XX", "HTTP client or authorization errors observed", "medium", "client-error"),
    ("HAR_SLOW_REQUESTS", "Slow HTTP requests observed", "medium", "latency"),
]
HAR_ORDER = [r[0] for r in HAR_RULES]
HAR_STEPS = ["Inspect the affected requests and timing phases.", "Correlate request timestamps with application and dependency logs."]

# Keys of JSON log lines in the order in which they are tried, for the two dialects.
A_TIME, B_TIME = ["timestamp", "time", "ts", "@timestamp"], ["timestamp", "time", "@timestamp", "ts"]
A_LEVEL, B_LEVELS = ["level", "severity", "log.level"], ["level", "severity"]
A_COMPONENT, B_COMPONENT = ["service", "component", "service.name", "logger"], ["service", "component", "logger"]
MESSAGE = ["message", "msg", "error"]
A_ID = ["request_id", "requestId", "trace_id", "traceId", "correlation_id", "correlationId", "x-request-id"]
B_ID = ["request_id", "requestId", "trace_id", "traceId", "correlation_id"]

# Types of artifacts whose lines are analysed, and the warnings of a bundle and of a run.
LOG_TYPES = ["generic-log", "json-log", "syslog", "nginx-access", "nginx-error", "apache-access", "apache-error", "php-log", "docker-log"]
NO_LOGS, NO_HAR = "no supported log artifacts were detected", "no HAR artifacts were detected"
NESTED = ("nested archive ", " was indexed but not extracted")
MANY_FINDINGS, MANY_EVENTS = "finding limit reached; additional findings were omitted", "timeline event limit reached; remaining events were not indexed"
BAD_HAR, LONG_LINE = "HAR file is malformed", "line is 1 MiB long or longer"
BAD_JSON, BAD_TYPE = "analyzer emitted invalid JSON", "analyzer emitted an unsupported response type"
RUN_NAME, TOOL_VERSION, SCHEMA_VERSION = "builtin-log-har", "0.1.0", "1"

# Volatile parts of messages.
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T ][0-9:.]+(?:Z|[+-][0-9:]+)?"
CORRELATION = r'(?i)(?:request[_-]?id|trace[_-]?id|correlation[_-]?id|x-request-id)[=:"\s]+([A-Za-z0-9._:-]+)'
VOLATILE_ID = r'(?i)\b(request[_-]?id|trace[_-]?id|correlation[_-]?id|x-request-id)([=:"\s]+)[A-Za-z0-9._:-]+'
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
IP = r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b"
NUMBER = r"\b\d{3,}\b"

# The second dialect of log parsing.
B_UUID = r"(?i)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b"
B_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
B_VOLATILE_ID = r"(?i)\b(request[_-]?id|trace[_-]?id|correlation[_-]?id)([=:]\s*)[A-Za-z0-9._:-]+"
B_LEVEL = r"(?i)\b(DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\b"
B_SERVICE = r"(?i)\b(?:service|component)[=:]\s*([A-Za-z0-9._-]+)"
B_CORRELATION = r"(?i)\b(?:request[_-]?id|trace[_-]?id|correlation[_-]?id)[=:]\s*([A-Za-z0-9._:-]+)"
B_SENSITIVE = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("bearer_token", r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]{12,}"),
    ("password", r"(?i)\b(?:password|secret|api[_-]?key)\s*[:=]\s*[^\s]+"),
]

# Kinds of sensitive data in the order in which they are replaced; the last four only in the strict profile.
STANDARD_KINDS = [
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("bearer_token", r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]{12,}"),
    ("basic_authorization", r"(?i)Basic\s+[A-Za-z0-9+/=]{8,}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("github_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("password", r"(?i)\b(?:password|passwd|pwd|api[_-]?key|secret|access[_-]?token|refresh[_-]?token)\s*[:=]\s*[^\s,;]{4,}"),
    ("connection_string", r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^\s]+"),
]
STRICT_KINDS = [
    *STANDARD_KINDS,
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("ipv4", IP),
    ("phone", r"\b\+?[1-9][0-9 ()-]{7,}[0-9]\b"),
    ("home_path", r"(?i)(?:/home/|/Users/|C:\\Users\\)[A-Za-z0-9._-]+"),
]

# Web and PHP rules as id, severity, title, pattern.
WEB_RULES = [
    ("PHP_FATAL_ERROR", "high", "Fatal PHP errors observed", r"(?i)PHP Fatal error|Uncaught (?:Error|Exception)"),
    ("PHP_MEMORY_LIMIT", "high", "PHP memory limit exhausted", r"(?i)Allowed memory size .* exhausted"),
    ("PHP_EXECUTION_TIMEOUT", "medium", "PHP execution time exceeded", r"(?i)Maximum execution time .* exceeded"),
    ("PHP_FPM_CAPACITY", "high", "PHP-FPM worker capacity exhausted", r"(?i)server reached pm\.max_children|pool .* seems busy"),
    ("WEB_UPSTREAM_TIMEOUT", "high", "Web upstream timeout observed", r"(?i)upstream timed out|gateway timeout"),
    ("WEB_PERMISSION_DENIED", "medium", "Web process permission denial observed", r"(?i)permission denied"),
]
HTTP_5XX = r'"\s+5\d{2}\s+'
THREAD_STATE = r"java\.lang\.Thread\.State:\s+([A-Z_]+)"
GC_PAUSE = r"(?i)(?:pause|stopped).*?([0-9]+(?:\.[0-9]+)?)ms"

# Windows events as id, rule, severity, title.
WINDOWS_EVENTS = [
    (4625, "WIN_AUTH_FAILURE", "medium", "Windows authentication failure recorded"),
    (6008, "WIN_UNEXPECTED_REBOOT", "high", "Unexpected Windows shutdown recorded"),
    (7031, "WIN_SERVICE_CRASH", "high", "Windows service terminated unexpectedly"),
    (1000, "WIN_APPLICATION_CRASH", "high", "Application crash event recorded"),
    (7, "WIN_DISK_WARNING", "high", "Disk I/O warning recorded"),
    (1014, "WIN_DNS_WARNING", "medium", "DNS resolution warning recorded"),
]

# Enumerations.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
TIMELINE_SEVERITIES = ["critical", "error", "warning", "info", "debug"]
SESSION_STATUSES = ["queued", "running", "completed", "failed"]
RUN_STATUSES = ["queued", "running", "completed", "completed_with_warnings", "failed", "timed_out", "skipped"]
STORED_STATUSES = ["queued", "running", "completed", "completed_with_warnings", "failed", "cancelled"]
REPORT_FORMATS = ["static-html", "json", "markdown", "sarif"]

# Analyzers and the types that they support.
ANALYZERS = [
    ("jvm", ["jvm-thread-dump", "jvm-gc-log", "jvm-arguments", "jvm-properties", "jvm-heap-dump"]),
    ("logs", ["generic-log", "json-log", "syslog", "docker-log"]),
    ("web", ["php-log", "php-config", "nginx-access", "nginx-error", "apache-access", "apache-error"]),
    ("windows", ["windows-event-xml", "windows-evtx"]),
]
