"""Secret scans: candidates from whole texts, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlog.llm.common import fold, stored, words

#: A candidate that nothing introduces: a run of these characters with a digit, of at least LEAST characters.
RUN, LEAST = r"[A-Za-z0-9_+/=.:@\-]{12,}", 12
#: A value that an assignment or key word introduces: any characters but quotes and commas, at least SHORT.
VALUE, SHORT = r"[^\s\"'`,]{4,}", 4
#: Log-probability of a pair that isn't two letters, or isn't in the dictionary.
UNKNOWN = -8.0
#: Labelled findings that the forest is fitted on, at most about; those planted in a context for either label; entries of the dictionary, at most.
SAMPLE, PLANTS, DICTIONARY = 20_000, 4, 50_000
# Words beside a candidate that speak for or against a secret.
FOR = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential|bearer|authorization|private[ _-]?key"
AGAINST = "sha1|sha256|md5|commit|checksum|isbn|uuid|version|example|http|www|mailto"
# Formats that providers give to their keys.
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|eyJ[\w-]+\.[\w-]+\.[\w-]*)$"
# The same inside a word.
FORMAT = f"(?<![A-Za-z0-9_])({FORMATS[2:-2]})(?![A-Za-z0-9_])"
# An assignment inside a word: its value goes up to the next one that "&", ";", "?", "#", "|" or a bracket introduces, so that a list of them has values that don't overlap.
KEY = r"[0-9_.\-\]]*+[A-Za-z][A-Za-z0-9_.\-\]]*+"
NEXT = r"[&;?#|(){}<>\[][0-9_.\-]*+[A-Za-z][A-Za-z0-9_.\-]*+[\"'`]?[=:](?!//)"
ASSIGNED = rf"(?<![A-Za-z0-9_.\-\]])({KEY})[\"'`]?[=:]++(?!//)[\"'`]?((?:(?!{NEXT})[^\s\"'`,]){{4,}}+)"
# One inside such a value: its own value ends at the next sign of an assignment.
INNER = rf"(?<![A-Za-z0-9_.\-\]])({KEY})[=:]++(?!//)(?=([^\s\"'`,=:]{{4,}}+))"
# The end of a word that introduces the next one.
INTRODUCES = rf"(?i)[=:][\"'`]?$|(^|[^a-z])({FOR})[\"'`]?$|^KEY-----$"
FEATURES = ["length", "digits", "upper", "lower", "symbols", "hex", "kinds_change", "case_change", "distinct", "transitions", "coverage", "longest_word", "slashes", "dots", "path", "extension", "at_signs", "url", "assigned", "near_for", "near_against", "quoted"]


def _share(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)) / F.length(col)


def _trimmed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"^[.:=/\-]+|[.:=\-]+$", ""))


def candidates(docs: DataFrame) -> DataFrame:
    """Candidates of all words of whole texts: doc_id, word_no, part, candidate, key, before, after, quoted.

    These are the values that an assignment (inside a word or over two) or a key word of FOR introduces, whatever they are
    made of; keys in a provider's format; and other runs with a digit. A word (between white space) may hold several;
    ``part`` numbers them. ``key`` is what stands before the value in an assignment inside the word; ``before`` are up to
    three words before, ``after`` one after.
    """
    split = docs.select("doc_id", words(F.col("text")).alias("w"))
    word = lambda i: F.get("w", i)
    run = lambda x: (F.length(x) >= LEAST) & x.rlike("[0-9]") & x.rlike(RUN)
    introduced = lambda i: F.coalesce(word(i - 1).rlike(INTRODUCES), F.lit(False))
    hit = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (F.length(word(i)) >= SHORT) & (run(word(i)) | word(i).rlike(ASSIGNED) | word(i).rlike(FORMAT) | introduced(i)))
    at = split.where(F.size("w") > 0).select("doc_id", "w", F.explode(hit).alias("i"))
    near = lambda lo, hi: F.concat_ws(" ", F.slice("w", F.greatest(F.lit(1), F.col("i") + 1 + lo), F.greatest(F.lit(0), F.least(F.col("i") + 1 + hi, F.size("w")) - F.greatest(F.lit(1), F.col("i") + 1 + lo) + 1)))
    found = at.select("doc_id", F.col("i").alias("word_no"), word(F.col("i")).alias("word"), introduced(F.col("i")).alias("introduced"), near(-3, -1).alias("before"), near(1, 1).alias("after"))

    def kept(key: Column, value: Column) -> Column:
        short = _trimmed(value)
        return F.struct(key.alias("key"), F.when(F.length(short) >= SHORT, short).otherwise(value).alias("candidate"))

    def of_run(x: Column) -> Column:  # an assignment inside the run: its value is the candidate
        key = F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9_.\-]*)[=:](?!//)", 1)
        value = F.when(key != "", F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9_.\-]*[=:]+", "")).otherwise(x)
        return F.struct(key.alias("key"), _trimmed(value).alias("candidate"))

    every = lambda pattern, group: F.regexp_extract_all("word", F.lit(pattern), F.lit(group))
    zipped = lambda x, pattern: F.arrays_zip(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(x, F.lit(pattern), F.lit(2)).alias("v"))
    assigned = F.transform(zipped(F.col("word"), ASSIGNED), lambda x: kept(x["k"], x["v"]))
    inner = F.transform(F.flatten(F.transform(every(ASSIGNED, 2), lambda v: zipped(v, INNER))), lambda x: kept(x["k"], x["v"]))
    whole = F.regexp_extract("word", rf"^[\"'`(\[{{<]*({VALUE})", 1)
    after = F.when(F.col("introduced") & (whole != ""), F.array(kept(F.lit(""), whole))).otherwise(F.array())
    formats = F.transform(every(FORMAT, 1), lambda x: F.struct(F.lit("").alias("key"), x.alias("candidate")))
    runs = F.filter(F.transform(every(f"({RUN})", 1), of_run), lambda x: (F.length(x["candidate"]) >= LEAST) & x["candidate"].rlike("[0-9]"))
    # of equal candidates the first stays: they lie side by side in the order of their texts
    placed = F.transform(F.concat(assigned, inner, after, formats, runs), lambda x, i: F.struct(x["candidate"].alias("candidate"), i.alias("i"), x["key"].alias("key")))
    found = found.withColumn("all", F.array_sort(placed))
    once = F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["candidate"] != x["candidate"]))
    parts = found.select("*", F.posexplode(F.array_sort(F.transform(once, lambda x: F.struct(x["i"].alias("i"), x["key"].alias("key"), x["candidate"].alias("candidate"))))).alias("part", "c"))
    return parts.select("doc_id", "word_no", "part", F.col("c.key").alias("key"), F.col("c.candidate").alias("candidate"), "before", "after", F.col("word").rlike("[\"'`]").cast("int").alias("quoted"))


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """The commonest words of 3 to 12 small letters of all texts, at most ``most``: entry."""
    own = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z])([a-z]{3,12})(?![a-z])"), 1)
    counts = stored(docs.select(F.explode(own).alias("entry")).groupBy("entry").agg(F.count("*").alias("c")), "entries")
    steps = counts.groupBy(F.floor(F.log2("c") * 16).alias("step")).agg(F.count("*").alias("k"), F.min("c").alias("low")).collect()
    least, room = 1 << 62, most
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["k"]
        if room < 0:
            break
        least = r["low"]
    return stored(counts.where(F.col("c") >= least).select("entry", "c"), "dictionary")


def _transitions(entries: DataFrame) -> Column:
    """Log-probabilities of a letter given the one before, in the dictionary's words by their counts: an array of 26 x 26 numbers."""
    pairs = entries.select("c", F.explode(F.transform(F.sequence(F.lit(1), F.length("entry") - 1), lambda i: F.substr("entry", i, F.lit(2)))).alias("pair"))
    pairs = pairs.groupBy("pair").agg(F.sum("c").alias("n"))
    firsts = pairs.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.sum("n").alias("all"))
    joined = pairs.join(firsts, F.substring("pair", 1, 1) == F.col("a"))
    place = (F.ascii("pair") - 97) * 26 + F.ascii(F.substring("pair", 2, 1)) - 97
    held = {r.i: r.lp for r in joined.select(place.alias("i"), F.ln((F.col("n") + 1) / (F.col("all") + 36)).alias("lp")).collect()}
    return F.array(*[F.lit(held.get(i, UNKNOWN)) for i in range(26 * 26)])


def features(found: DataFrame, entries: DataFrame) -> DataFrame:
    """``found`` (candidates with a unique ``row``) with the columns FEATURES.

    The dictionary has at most DICTIONARY entries, which are broadcast, and there are 26 x 26 transitions, which are a constant of the plan.
    """
    c = F.col("candidate")
    base = found.select(
        "*",
        F.length(c).cast("double").alias("length"),
        _share(c, "[0-9]").alias("digits"),
        _share(c, "[A-Z]").alias("upper"),
        _share(c, "[a-z]").alias("lower"),
        _share(c, "[^A-Za-z0-9]").alias("symbols"),
        F.regexp_like(c, F.lit("^[0-9a-fA-F]+$")).cast("int").alias("hex"),
        _share(c, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])").alias("kinds_change"),
        _share(c, "[a-z](?=[A-Z])|[A-Z](?=[a-z])").alias("case_change"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.length(c)).alias("distinct"),
        F.regexp_count(c, F.lit("/")).cast("int").alias("slashes"),
        F.regexp_count(c, F.lit(r"\.")).cast("int").alias("dots"),
        F.regexp_like(c, F.lit(r"^([A-Za-z]:|~|\.{1,2})?[/\\]?([\w.\-]+[/\\])+[\w.\-]*$")).cast("int").alias("path"),
        F.regexp_like(c, F.lit(r"\.[A-Za-z]{1,5}$")).cast("int").alias("extension"),
        F.regexp_count(c, F.lit("@")).cast("int").alias("at_signs"),
        c.contains("://").cast("int").alias("url"),
        F.regexp_like(F.concat_ws(" ", "key", "before"), F.lit(r"(?i)^\S+ |[=:]\s*$")).cast("int").alias("assigned"),
        F.regexp_like(F.concat_ws(" ", "before", "key"), F.lit(f"(?i)(^|[^a-z])({FOR})([^a-z]|$)")).cast("int").alias("near_for"),
        F.regexp_like(F.concat_ws(" ", "before", "key", "after", c), F.lit(f"(?i)(^|[^a-z])({AGAINST})([^a-z]|$)")).cast("int").alias("near_against"),
    )
    low = F.lower("candidate")
    runs = found.select("row", F.length("candidate").alias("of"), F.explode(F.regexp_extract_all(low, F.lit("([a-z]{3,})"), 1)).alias("run"))
    covered = runs.join(F.broadcast(entries.select("entry")), F.col("run") == F.col("entry"))
    covered = covered.groupBy(F.col("row").alias("_r1")).agg((F.sum(F.length("run")) / F.first("of")).alias("_covered"), F.max(F.length("run")).alias("_longest"))
    # letters as numbers, once for a candidate; a pair's place in the array is found without a search
    codes = F.transform(F.split(low, ""), lambda x: F.ascii(x) - 97)
    base, rated = base.withColumn("_codes", codes), _transitions(entries)
    letter = lambda x: (x >= 0) & (x < 26)
    pairs = F.zip_with("_codes", F.slice("_codes", 2, F.greatest(F.length("candidate"), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.when(letter(a) & letter(b), F.get(rated, a * 26 + b)).otherwise(UNKNOWN)))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    base = base.withColumn("transitions", F.when(F.length("candidate") > 1, total / (F.length("candidate") - 1)).otherwise(UNKNOWN)).drop("_codes")
    out = base.join(covered, F.col("row") == F.col("_r1"), "left")
    out = out.withColumns({"coverage": F.coalesce("_covered", F.lit(0.0)), "longest_word": F.coalesce("_longest", F.lit(0))})
    return out.select(*found.columns, *[F.col(f).cast("double") for f in FEATURES if f != "quoted"])


def labelled(found: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for keys in a provider's format, which nothing else looks like; else null."""
    return found.withColumn("label", F.when(F.col("candidate").rlike(FORMATS), 1.0))


def planted(found: DataFrame, plants: int = PLANTS, seed: int = 9) -> DataFrame:
    """Labelled findings: in the place of each finding of ``found`` values whose truth is known, since they are put there.

    With label 1 random keys and passwords: hex, base64, letters and digits, words with a number, as values of a key word, and providers'
    keys anywhere. With label 0 addresses, links, paths, numbers, times, names, digests beside words like commit or checksum,
    and plain words as values of a key word. Values come from a hash of the finding's place, words from the texts around it.
    """
    near = F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit("([a-z]{3,12})"), 1)
    rows = found.select("*", near.alias("near"), F.explode(F.sequence(F.lit(0), F.lit(2 * plants - 1))).alias("k"))
    rows = rows.withColumns({"label": (F.col("k") % 2).cast("double"), "h": F.sha2(F.concat_ws("|", F.lit(seed), "doc_id", "word_no", "part", "k"), 256)})
    rows = rows.withColumns({"b64": F.base64(F.unhex("h")), "n": F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), "m": F.conv(F.substring("h", 9, 8), 16, 10).cast("long")})
    word = lambda at, other: F.coalesce(F.get("near", F.pmod(at, F.greatest(F.size("near"), F.lit(1))).cast("int")), F.lit(other))
    rows = rows.withColumns({"w": word(F.col("n"), "garden"), "v": word(F.col("m"), "river"), "alnum": F.regexp_replace("b64", "[^A-Za-z0-9]", "")})
    n, m, w, v = (F.col(c) for c in ("n", "m", "w", "v"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    cut = lambda c, least, span: F.substr(F.col(c), F.lit(1), (least + F.pmod(m, F.lit(span))).cast("int"))
    key = lambda at: F.element_at(F.array(*map(F.lit, ["password", "passwd", "pwd", "secret", "token", "api_key", "access_key", "db_password"])), (F.pmod(at, F.lit(8)) + 1).cast("int"))
    keyed = [cut("h", 16, 49), cut("b64", 16, 28), cut("alnum", 8, 12), text(F.initcap(w), "-", v, m % 1000), text(cut("alnum", 4, 6), "!", m % 100)]
    formats = [text("AKIA", F.upper(cut("alnum", 16, 1))), text("ghp_", F.rpad("alnum", 36, "x")), text("sk-", cut("alnum", 24, 16))]
    harmless = [
        text(w, ".", v, m % 100, "@mail", m % 9, ".example.org"), text("https://", w, ".example.com/", v, "/", m), text("/usr/", w, "/", v, m % 10, "/", w, ".txt"), text(n, F.lpad((m % 1_000_000).cast("string"), 6, "0")),
        text(n % 223 + 1, ".", m % 256, ".", n % 251, ".", m % 249), text("20", n % 30 + 10, "-0", m % 9 + 1, "-1", n % 9, "T1", m % 9, ":0", n % 9, ":00Z"), text(w, "_", v, "_", m % 1000), cut("h", 40, 1), cut("h", 32, 1), w, F.lit("required"),
    ]
    kind = F.pmod(n + m, F.lit(len(keyed) + len(formats)))
    other = F.pmod(n + m, F.lit(len(harmless)))
    pick = lambda values, at: F.element_at(F.array(*values), (at + 1).cast("int"))
    secret, digest, plain = F.col("label") == 1, F.col("other").isin(7, 8), F.col("other") >= 9
    rows = rows.withColumns({"kind": kind, "other": other})
    introduced = (secret & (F.col("kind") < len(keyed))) | (~secret & plain)
    inside = m % 2 == 0  # the key word stands in the word itself, or before it
    clean = lambda c: F.regexp_replace(c, f"(?i)({FOR})", "")
    before = F.when(introduced & ~inside, F.concat_ws(" ", clean(F.col("before")), key(n), F.lit("="))).when(~secret & digest, F.concat_ws(" ", clean(F.col("before")), F.when(n % 2 == 0, "commit").otherwise("checksum")))
    return rows.select(
        "row", "doc_id", "word_no", (F.col("part") * 2 * plants + F.col("k")).alias("part"),
        F.when(introduced & inside, key(n)).otherwise("").alias("key"),
        F.when(secret, pick([*keyed, *formats], F.col("kind"))).otherwise(pick(harmless, F.col("other"))).alias("candidate"),
        F.coalesce(before, clean(F.col("before"))).alias("before"), "after", (n % 2).cast("int").alias("quoted"), "label",
    ).withColumn("row", F.monotonically_increasing_id())


def train(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 9) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (FEATURES and ``label``); None if they don't hold both labels."""
    low, high = findings.agg(F.min("label"), F.max("label")).first()
    if low == high:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def classify(findings: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Adds ``score``, the forest's probability of a secret; without a forest the label, or 0."""
    if model is None:
        return findings.withColumn("score", F.coalesce("label", F.lit(0.0)))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(findings).withColumnRenamed("_features", "features"))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def training(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Planted findings with their features, at most about SAMPLE: in the places of findings chosen by a hash of place and value."""
    most = SAMPLE // (2 * PLANTS)
    part = F.pmod(F.xxhash64("doc_id", "word_no", "part", "candidate"), F.lit(1_000_000)) < int(min(1.0, most / max(1, found.count())) * 1_000_000)
    places = found.where(part).dropDuplicates(["doc_id", "word_no", "part", "candidate"])
    return features(stored(planted(places), "planted"), entries)


def scan(docs: DataFrame, folds: int = 5) -> DataFrame:
    """All candidates of whole texts with their score: doc_id, word_no, part, candidate, held_out, label, score, secret.

    ``docs`` has doc_id and text; other columns are ignored. The forest learns from findings of known truth, planted in the places of
    candidates of the documents whose crc32(doc_id as text) mod ``folds`` is not 0. ``secret`` is score >= 0.5 or a
    provider's format (label 1). Null and empty texts have no candidate; null ids are held out; repeated rows give repeated findings; an
    empty table gives an empty table, and without training documents only formats are secrets.
    """
    docs = docs.select("doc_id", "text")
    held = fold(F.col("doc_id"), folds) == 0
    found = stored(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "candidates")
    entries = dictionary(docs)
    model = train(stored(training(found.where(~held), entries), "training"))
    rated = stored(labelled(features(found, entries)), "findings")
    scored = classify(rated.withColumn("held_out", held), model)
    return scored.select("doc_id", "word_no", "part", "candidate", "held_out", "label", "score", ((F.col("score") >= 0.5) | F.col("label").isNotNull()).alias("secret"))
