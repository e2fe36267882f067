"""Line numbers that don't depend on how files are cut, and archives that stop at their limits."""

import gzip
import io
import tarfile
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fernlog.jobs import analyze
from fernlog.operators.inventory import Limits
from fernlog.sources import readers, store


@pytest.fixture
def packing(spark):
    """Sets how files are cut and packed; puts it back at the end."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    yield lambda most, cost: (spark.conf.set(names[0], most), spark.conf.set(names[1], cost))
    for n, v in old.items():
        spark.conf.set(n, v)


def test_numbers_hold_when_files_are_packed_otherwise(spark, tmp_path, packing):
    for k in range(40):
        (tmp_path / f"f{k:02}.log").write_bytes(b"".join(b"file %d line %d%s\n" % (k, i, b"\r" * (i % 2)) for i in range(1, 20 + k)))
    (tmp_path / "long.log").write_bytes(b"".join(b"file 99 line %d\n" % i for i in range(1, 5001)))
    (tmp_path / "none.log").write_bytes(b"")
    (tmp_path / "open.log").write_bytes(b"file 98 line 1\nfile 98 line 2")
    with gzip.open(tmp_path / "z.log.gz", "wb") as f:
        f.write(b"file 97 line 1\nfile 97 line 2\n")
    packing("4k", "0")
    lines = readers.read_lines(spark, f"file://{tmp_path}")
    for most, cost in (("4k", "0"), ("128m", "4m"), ("1k", "1m"), ("64m", "1")):
        packing(most, cost)
        rows = lines.collect()
        assert len(rows) == sum(range(19, 59)) + 5000 + 2 + 2
        assert all(r.line.endswith(f" line {r.line_no}") for r in rows)
        assert max(Counter((r.artifact, r.line_no) for r in rows).values()) == 1


def test_collected_lines_are_few_files_and_keep_their_numbers(spark, tmp_path, packing):
    """Many small artifacts make no file each, a long one goes on in other files, and names and texts come back as they are."""
    names = [*((f"b{k % 7}", f"logs/a{k}.log") for k in range(300)), (None, "tab\t and\nline"), ("", None), ("b%7E~", "é/\"x\".log")]
    small = [(*name, i, f"\t{name} {i}" if i % 4 else "") for name in names for i in range(1, 4)]
    long = [("b3", "logs/long.log", i, f"line {i}" + "\r" * (i % 2)) for i in range(1, 20_001)]
    schema = "bundle_id string, artifact string, line_no bigint, line string"
    lines = spark.createDataFrame(small + long, schema).repartition(5)
    path, few = tmp_path / "logs", "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(few)
    spark.conf.set(few, "false")
    readers.write_collected(lines, f"file://{path}")
    spark.conf.set(few, old)
    files = list(path.glob("part-*"))
    assert sum(b"logs/long.log" in f.read_bytes() for f in files) > 1
    assert len(files) < 100 and not [f for f in path.iterdir() if f.is_dir()]
    want = Counter([*small, *((*r[:3], r[3].rstrip("\r")) for r in long)])
    for most, cost in (("4k", "0"), ("128m", "4m")):
        packing(most, cost)
        assert Counter(map(tuple, readers.read_collected(spark, f"file://{path}").collect())) == want


def zipped(files, kind=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", kind) as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def tarred(files, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
            else:
                info.size = len(data)
            t.addfile(info, io.BytesIO(data or b""))
    return out.getvalue()


def write(folder, archives):
    for name, data in archives.items():
        (folder / name).write_bytes(data)
    return f"file://{folder}"


@pytest.mark.parametrize("row_bytes", [readers.ROW_BYTES, 0])
def test_an_archive_stops_at_its_first_bad_entry(spark, tmp_path, row_bytes):
    """Whether it comes as a row or is opened where it lies."""
    big = [(f"d/f{k}.log", b"x" * (1 << 20)) for k in range(60)]
    archives = {
        "total.zip": zipped(big, zipfile.ZIP_STORED), "total.tar.gz": tarred(big), "total.tar.xz": tarred(big, "w:xz"), "total.tar.bz2": tarred(big, "w:bz2"), "ratio.zip": zipped(big), "one.gz": gzip.compress(b"y" * 5_000_000, 1),
        "same.zip": zipped([("a/b.log", b"1"), ("A//./b.LOG", b"2")]), "up.tar": tarred([("ok", b"1"), ("../x", b"2"), ("ok", b"3")], "w"), "link.tar": tarred([("ok", b"1"), ("l", None)], "w"),
        "fine.zip": zipped([("d/", b""), ("d/one.txt", b"1"), ("two.txt", b"22")]), "fine é %41.tar": tarred([("é.txt", b"333")], "w"), "c.gz": gzip.compress(b"4444"), "torn.zip": zipped(big, zipfile.ZIP_STORED)[:3_000_000], "torn.tgz": tarred(big)[:1_500], "words.zip": b"no archive",
    }
    limits = Limits(total_bytes=2 << 20, file_bytes=3 << 20)
    rows = readers.expand_bundles(readers.read_archives(spark, write(tmp_path, archives), row_bytes), limits).collect()
    by = {n: [r for r in rows if r.bundle_id.endswith("/" + n)] for n in archives}
    assert {n: r[-1].code for n, r in by.items()} == {
        "total.zip": "limit-exceeded", "total.tar.gz": "limit-exceeded", "total.tar.xz": "limit-exceeded", "total.tar.bz2": "limit-exceeded", "ratio.zip": "limit-exceeded", "one.gz": "limit-exceeded",
        "same.zip": "unsafe-entry", "up.tar": "path-traversal", "link.tar": "unsafe-entry", "fine.zip": "ok", "fine é %41.tar": "ok", "c.gz": "ok", "torn.zip": "artifact-malformed", "torn.tgz": "artifact-malformed", "words.zip": "artifact-malformed",
    }
    assert sum(r.size for r in by["total.zip"] if r.content) == 2 << 20
    for found in by.values():
        assert [r.code is None for r in found] == [True] * (len(found) - 1) + [False] and sum(len(r.content or b"") for r in found) <= 2 << 20
    assert [(r.name, r.path, bytes(r.content)) for r in by["fine.zip"][:-1]] == [("d/one.txt", "d/one.txt", b"1"), ("two.txt", "two.txt", b"22")]
    import hashlib

    assert by["fine é %41.tar"][-1].input_sha256 == hashlib.sha256(archives["fine é %41.tar"]).hexdigest()


def test_limits_of_files_names_and_sizes(spark, tmp_path):
    archives = {"many.zip": zipped([(f"{k}", b"") for k in range(5)]), "name.zip": zipped([("n" * 40, b"")]), "size.zip": zipped([("a", b"12345678")], zipfile.ZIP_STORED), "fits.zip": zipped([("a", b"1234567"), ("b", b""), ("c", b"1")], zipfile.ZIP_STORED)}
    rows = readers.expand_bundles(readers.read_archives(spark, write(tmp_path, archives)), Limits(files=3, name_bytes=30, file_bytes=7, total_bytes=8)).where("code IS NOT NULL").collect()
    assert {r.bundle_id.rsplit("/", 1)[1]: r.code for r in rows} == {"many.zip": "limit-exceeded", "name.zip": "limit-exceeded", "size.zip": "limit-exceeded", "fits.zip": "ok"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_main_job_moves_no_contents(spark, tmp_path, monkeypatch):
    """No exchange of any plan of the job holds the bytes, and they are written once."""
    written = []

    def watch(df, what, by=None, keep=analyze.stored):
        written.append((what, "content" in df.columns, plan_of(df)))
        return keep(df, what, by=by)

    monkeypatch.setattr(analyze, "stored", watch)
    monkeypatch.setattr(readers, "stored", watch)
    (tmp_path / "in").mkdir()
    log = "\n".join(f"2025-05-05T10:00:0{k}Z ERROR request_id=r{k} connection refused me@x.example" for k in range(5))
    path = write(tmp_path / "in", {"a.zip": zipped([("a.log", log), ("n.txt", "you@x.example"), ("x.har", '{"log": {"entries": []}}')]), "bad.zip": zipped([("../a.log", log)])})
    analyze.analyze_bundles(spark, path, f"file://{tmp_path}/out")
    assert [what for what, whole, _ in written if whole] == ["contents"]
    for what, _, plan in written:
        for part in plan.split("Exchange")[1:]:
            assert "content#" not in part.split("\n")[0], what
        assert not (what == "contents" and "Exchange" in plan)
    t = store.load_workspace(spark, f"file://{tmp_path}/out")
    assert t["findings"].first().occurrences == 5 and t["timeline"].count() == 5 and t["rejected"].first().code == "path-traversal"
    assert {(r.artifact, r.kind): r.matches for r in t["sensitive"].collect()} == {("a.log", "email"): 5, ("n.txt", "email"): 1}
    assert t["report"].count() == 1 and t["manifest"].first().input_name == "a.zip"


def test_own_rules_in_the_job(spark):
    rules = store.load_rule_pack('{"version": "1", "name": "own-rules", "rules": [{"id": "MY_RULE", "title": "a title", "category": "own", "severity": "low", "pattern": "refused", "confidence": "weak"}]}')
    files = spark.createDataFrame([("b", "a.log", bytearray(b"2025-05-05T10:00:00Z INFO Refused\nother\nconnection REFUSED"))], "bundle_id string, path string, content binary")
    found = analyze.analyze_artifacts(files, rules=rules)["findings"].collect()
    assert sorted((r.rule_id, r.confidence, r.occurrences, r.evidence[0].line_start) for r in found) == [("MY_RULE", "weak", 1, 1), ("MY_RULE", "weak", 1, 3)]


def test_facts_equal_the_separate_passes(spark, sf_dir):
    from fernlog.operators import logs
    from fernlog.testlines import derived

    lines = derived(spark, sf_dir, "lines").withColumn("sha256", F.sha2("artifact", 256))
    facts = logs.line_facts(lines)
    pairs = [(logs.findings_of(facts), logs.log_findings(lines)), (logs.timeline_of(facts), logs.log_timeline(logs.parse_log_a(lines))), (logs.sensitive_of(facts), logs.privacy_counts(lines, "line", logs.K)), (logs.failed_of(facts), logs.failed_files(lines))]
    for a, b in pairs:
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
