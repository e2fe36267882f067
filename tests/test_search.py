"""Stems against the examples of the paper, and the index against plain search."""

import random
import re

from pyspark.sql import functions as F

from fernlog.operators import search
from fernlog.operators.query import STOP

# Examples of Porter's paper, word and stem after all steps.
PAPER = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll is is by by x1ing x1ing""".split()


def test_stems_of_the_paper(spark):
    pairs = list(zip(PAPER[::2], PAPER[1::2], strict=True))
    got = spark.createDataFrame([(w,) for w, _ in pairs], "w string").select("w", search.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == dict(pairs)


def table(spark):
    rng = random.Random(2)
    words = "connection connections connected refused refusing refuses database failing failed the of timeout query queries pool pooled 42 x9".split()
    rows = [(rng.choice("bc"), f"i{k:03}", " ".join(rng.choices(words, k=rng.randint(1, 6))), " ".join(rng.choices(words, k=rng.randint(0, 8))) or None, rng.choice(["api", "pool", None]), rng.choice(["LOG_REFUSED", "DB_QUERY", None])) for k in range(200)]
    return rows, spark.createDataFrame(rows, "bundle_id string, id string, title string, summary string, component string, rule_id string")


def plain(rows, stems, alternatives):
    """alternatives: (must, never) of phrases as words with their distances."""
    out = []
    for b, i, *texts, comp, rule in rows:
        at, weight, place = {}, {}, 0
        for text, w in ((texts[0], 100), (texts[1], 40), (" ".join(x for x in (comp, (rule or "").replace("_", " ") if rule else None) if x), 20)):
            for word in re.findall("[a-z0-9]+", (text or "").lower()):
                place += 1
                if word not in STOP:
                    t = word if w == 20 else stems[word]
                    at.setdefault(t, set()).add(place)
                    weight[t] = weight.get(t, 0) + w
        holds = lambda p, at=at: any(all(s + k in at.get(stems[w], ()) for w, k in p) for s in at.get(stems[p[0][0]], ()))
        if any(all(map(holds, must)) and not any(map(holds, never)) for must, never in alternatives):
            wanted = {stems[w] for must, _ in alternatives for p in must for w, _ in p}
            out.append((-sum(weight.get(t, 0) for t in wanted) / 100, i, b))
    return [(b, i, -r) for r, i, b in sorted(out)]


def test_search_equals_plain_search(spark, tmp_path):
    rows, df = table(spark)
    vocabulary = {w for r in rows for t in r[2:] for w in re.findall("[a-z0-9]+", (t or "").lower())} | {"refusal", "pooling", "refuse"}
    stems = {r.w: r.s for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", search.stem(F.col("w")).alias("s")).collect()}
    path = f"file://{tmp_path}/index"
    search.write_search_index(df, path)
    index = spark.read.parquet(path)
    one = lambda *words: [[(w, 0)] for w in words]
    cases = {
        "refusing the connections": [(one("refusing", "connections"), [])],
        '"connection refused"': [([[("connection", 0), ("refused", 1)]], [])],
        '"pool of queries" or timeout -failed': [([[("pool", 0), ("queries", 2)]], []), (one("timeout"), one("failed"))],
        "database -\"connection refused\" -x9": [(one("database"), [[("connection", 0), ("refused", 1)], [("x9", 0)]])],
        "42, pooling!": [(one("42", "pooling"), [])],
    }
    for text, alternatives in cases.items():
        want = plain(rows, stems, alternatives)
        got = [tuple(r) for r in search.search_index(index, text, limit=1000).collect()]
        assert got == want and (len(want) > 3 or "of" in text), text
        assert [tuple(r) for r in search.search_index(index, text, session="b", limit=5).collect()] == [w for w in want if w[0] == "b"][:5]
    for nothing in ("", "the of", "-timeout", '""', "or"):
        assert search.search_index(index, nothing).count() == 0


def test_a_search_reads_the_terms_of_its_query(spark, tmp_path):
    _, df = table(spark)
    path = f"file://{tmp_path}/index"
    search.write_search_index(df, path)
    plan = search.search_index(spark.read.parquet(path), "refused queries", session="b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bundle_id" in plan and "In(term, [queri,refus])" in plan


def test_files_of_an_index_follow_its_rows_not_its_bundles(spark, tmp_path):
    """A folder for each bundle made 120,000 of them at scale, which every search listed."""
    rows = [(f"b{i}", f"f{i}", "Database errors", "", "", "R") for i in range(200)]
    findings = spark.createDataFrame(rows, "bundle_id string, id string, title string, summary string, component string, rule_id string")
    search.write_search_index(findings, f"file://{tmp_path}/index", folders=False)
    assert len(list(tmp_path.rglob("*.parquet"))) <= 8
    index = spark.read.parquet(f"file://{tmp_path}/index")
    assert [(r.bundle_id, r.id) for r in search.search_index(index, "errors", session="b17").collect()] == [("b17", "f17")]
    assert search.search_index(index, "errors", limit=None).count() == 200
