"""Stemmed search over a stored inverted index of findings.

``index_findings`` gives a row for each term of a finding, with its weight and positions; ``search_index`` reads the rows of a query's terms and
nothing else. Title and summary are stemmed, component and rule are kept as they are; so a query's words match the latter only if their
stems stand there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlog.operators.query import STOP, WEIGHTS

# The suffixes of M. F. Porter, "An algorithm for suffix stripping" (1980), steps 2, 3 and 4, in its order.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# A run of consonants and one of vowels (y is a vowel after a consonant), and what the paper calls m > 0, m = 1, m > 1, *v* and *o.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M0, M1, M2 = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$", f"^(?:{_C})?{_V}{_C}{_V}{_C}"
VOWEL, CVC = f"^(?:{_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
#: Doubled letters that are made single.
DOUBLES = "|".join(f"{c}{c}" for c in "bcdfghjkmnpqrtvwx")


def _cut(w: Column, n: int) -> Column:
    return F.substr(w, F.lit(1), F.length(w) - n)


def _swap(w: Column, table: dict[str, str], test: str) -> Column:
    """The longest suffix of the table becomes what stands there, if the rest passes the test."""
    out = w
    for suffix, to in sorted(table.items(), key=lambda x: len(x[0])):
        rest = _cut(w, len(suffix))
        out = F.when(F.endswith(w, F.lit(suffix)), F.when(rest.rlike(test), F.concat(rest, F.lit(to))).otherwise(w)).otherwise(out)
    return out


def _plural(w: Column) -> Column:
    ends = lambda s: F.endswith(w, F.lit(s))
    return F.when(ends("sses") | ends("ies"), _cut(w, 2)).when(ends("ss"), w).when(ends("s"), _cut(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    """Step 1b; a mark at the end says that a suffix has gone, so that the next step mends what is left."""
    ends = lambda s: F.endswith(w, F.lit(s))
    gone = lambda n: F.when(_cut(w, n).rlike(VOWEL), F.concat(_cut(w, n), F.lit("!"))).otherwise(w)
    return F.when(ends("eed"), F.when(_cut(w, 3).rlike(M0), _cut(w, 1)).otherwise(w)).when(ends("ed"), gone(2)).when(ends("ing"), gone(3)).otherwise(w)


def _mended(w: Column) -> Column:
    s = F.rtrim(w, F.lit("!"))
    e = F.concat(s, F.lit("e"))
    fixed = F.when(s.rlike("(?:at|bl|iz)$"), e).when(s.rlike(f"(?:{DOUBLES})$"), _cut(s, 1)).when(s.rlike(M1) & s.rlike(CVC), e).otherwise(s)
    return F.when(F.endswith(w, F.lit("!")), fixed).otherwise(w)


def _last_y(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("y")) & _cut(w, 1).rlike(VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _bare(w: Column) -> Column:
    """Step 4."""
    out = w
    for suffix in sorted(STEP4, key=len):
        rest = _cut(w, len(suffix))
        fine = rest.rlike(M2) & rest.rlike("[st]$") if suffix == "ion" else rest.rlike(M2)
        out = F.when(F.endswith(w, F.lit(suffix)), F.when(fine, rest).otherwise(w)).otherwise(out)
    return out


def _last_e(w: Column) -> Column:
    rest = _cut(w, 1)
    return F.when(F.endswith(w, F.lit("e")) & (rest.rlike(M2) | (rest.rlike(M1) & ~rest.rlike(CVC))), rest).otherwise(w)


def _last_l(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("ll")) & _cut(w, 1).rlike(M2), _cut(w, 1)).otherwise(w)


_STEPS = [_plural, _past, _mended, _last_y, lambda w: _swap(w, STEP2, M0), lambda w: _swap(w, STEP3, M0), _bare, _last_e, _last_l]


def stem(word: Column) -> Column:
    """Porter's stem of a lower-case word; words of one or two letters, and what holds anything but a-z, stay as they are."""
    w = F.array(word)
    for step in _STEPS:  # each step uses its word many times: as an element of an array it is worked out once
        w = F.transform(w, step)
    return F.when((F.length(word) > 2) & word.rlike("^[a-z]+$"), F.get(w, F.lit(0))).otherwise(word)


def _words(text: Column) -> Column:
    """(word, place) of a text, places counting all words, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.transform(found, lambda w, i: F.struct(w.alias("word"), i.alias("place")))


def index_findings(findings: DataFrame, keys: tuple[str, ...] = ("bundle_id", "id")) -> DataFrame:
    """The inverted index: ``keys``, term, weight (1.0 for each time in the title, 0.4 summary, 0.2 component and rule), positions (rising).

    Positions run through title, summary, component and rule, and count stop words, so that phrases can be told. Null columns are empty.
    """
    parts = {"A": F.col("title"), "B": F.col("summary"), "C": F.concat_ws(" ", "component", F.replace("rule_id", F.lit("_"), F.lit(" ")))}
    rows = findings.select(*keys, *[_words(c).alias(f"_{k}") for k, c in parts.items()])
    moved = lambda k, start: F.transform(F.col(f"_{k}"), lambda w: F.struct(w["word"].alias("word"), (w["place"] + start + 1).alias("place"), F.lit(k).alias("part")))
    start, places = F.lit(0), []
    for k in parts:
        places.append(moved(k, start))
        start = start + F.size(F.col(f"_{k}"))
    each = rows.select(*keys, F.inline(F.filter(F.concat(*places), lambda w: ~w["word"].isin(STOP))))
    term = F.when(F.col("part") == "C", F.col("word")).otherwise(stem(F.col("word"))).alias("term")
    # in hundredths, so that sums are exact
    weight = F.create_map(*[F.lit(x) for k, v in WEIGHTS.items() for x in (k, round(100 * v))])[F.col("part")]
    return each.select(*keys, term, "place", weight.alias("w")).groupBy(*keys, "term").agg((F.sum("w") / 100).alias("weight"), F.sort_array(F.collect_list("place")).alias("positions"))


def write_search_index(findings: DataFrame, path: str, folders: bool = True) -> None:
    """The index as Parquet in the order of bundles and terms inside its files, so that a search reads a bundle's few row groups that may hold its
    terms. Each bundle has a folder; without ``folders``, for many bundles, the number of files follows the rows instead, and
    the files' statistics tell where a bundle is."""
    rows = index_findings(findings).repartition("bundle_id").sortWithinPartitions("bundle_id", "term", "id")
    (rows.write.partitionBy("bundle_id") if folders else rows.write).parquet(path)


@dataclass
class Query:
    """Alternatives, each with phrases (lists of words and their distances from the first) that must stand in a finding, and some that must not."""

    alternatives: list[tuple[list, list]] = field(default_factory=list)
    words: list[str] = field(default_factory=list)


def parse_query(text: str) -> Query:
    """A query as people type it: words, "phrases", ``or`` between alternatives, ``-`` before what must not be there.

    Whatever else is typed is white space. Stop words only count as places of a phrase. An alternative without anything that must be there matches nothing.
    """
    out, must, never = Query(), [], []

    def close() -> None:
        if must:
            out.alternatives.append((list(must), list(never)))
        must.clear()
        never.clear()

    for minus, phrase, word in re.findall(r'(?:(?<!\S)(-))?(?:"([^"]*)"|([^\s"]+))', text):
        if word.lower() == "or" and not minus:
            close()
            continue
        found = [(w, k) for k, w in enumerate(re.findall("[a-z0-9]+", (phrase or word).lower())) if w not in STOP]
        if found:
            (never if minus else must).append([(w, k - found[0][1]) for w, k in found])
            out.words += [w for w, _ in found]
    close()
    return out


def search_index(index: DataFrame, query: str, session: str | None = None, limit: int | None = 50) -> DataFrame:
    """bundle_id, id and rank of the findings that ``query`` matches, the highest rank first, then by id.

    The rank is the sum of the weights of the query's words that are in the finding and not excluded. Only rows of its terms are read and shuffled. A query without
    words gives no rows; without ``limit`` all are returned.
    """
    spark, parsed = index.sparkSession, parse_query(query)
    if session is not None:
        index = index.where(F.col("bundle_id") == session)
    if not parsed.alternatives:
        return index.limit(0).select("bundle_id", "id", F.lit(0.0).alias("rank"))
    stems = {r.w: r.s for r in spark.createDataFrame([(w,) for w in set(parsed.words)], "w string").select("w", stem(F.col("w")).alias("s")).collect()}
    hits = index.where(F.col("term").isin(sorted(set(stems.values()))))
    at = F.map_from_entries(F.collect_list(F.struct("term", "positions")))
    weights = F.map_from_entries(F.collect_list(F.struct("term", "weight")))
    rows = hits.groupBy("bundle_id", "id").agg(at.alias("at"), weights.alias("weights"))

    def holds(phrase: list[tuple[str, int]]) -> Column:
        of = lambda w: F.try_element_at("at", F.lit(stems[w]))
        ok = F.exists(of(phrase[0][0]), lambda p: _all([F.array_contains(of(w), p + k) for w, k in phrase[1:]]))
        return F.coalesce(ok, F.lit(False))

    match, wanted = F.lit(False), set()
    for must, never in parsed.alternatives:
        match = match | (_all([holds(p) for p in must]) & ~_any([holds(p) for p in never]))
        wanted |= {stems[w] for p in must for w, _ in p}
    rank = sum((F.coalesce(F.try_element_at("weights", F.lit(t)), F.lit(0.0)) for t in sorted(wanted)), F.lit(0.0))
    found = rows.where(match).select("bundle_id", "id", F.round(rank, 6).alias("rank")).orderBy(F.desc("rank"), "id")
    return found if limit is None else found.limit(limit)


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
