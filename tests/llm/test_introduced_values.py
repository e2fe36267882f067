from fernlog.llm import secret_scan


def test_introduced_values_and_formats_are_candidates(spark):
    """Whatever an assignment or key word introduces is a candidate, without a digit and however short; so is a provider's key."""
    key, longer = "AKIA" + "ABCDEFGHIJKLMNOP", "ghp_" + "abcdefghijKLMNOPQRSTuvwxyzabcd"
    values = {
        1: ("say password=Tr0ub4dor&3, then", "Tr0ub4dor&3"),
        2: ("the pwd: hunter22 is", "hunter22"),
        3: ("secret=CorrectHorseBattery", "CorrectHorseBattery"),
        4: (f"use {key} now", key),
        5: (f'x="({longer})"', longer),
        6: ('{"api_key":"ab!d"}', "ab!d"),
        7: ("Authorization: Bearer qwertyuiop", "qwertyuiop"),
        8: ("token = 'p%w^rd'", "p%w^rd"),
        9: ("https://a.example/?q=1&token=abcd", "abcd"),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in values.items()] + [(20, "no value of any kind is here, only words")], "doc_id bigint, text string")
    got = {(r.doc_id, r.candidate) for r in secret_scan.candidates(docs).collect()}
    assert got >= {(k, v) for k, (_, v) in values.items()}
    assert not any(k == 20 for k, _ in got)
    rows = secret_scan.scan(docs).collect()
    assert {(r.doc_id, r.candidate) for r in rows} == got
    assert all(r.label == 1.0 for r in rows if r.candidate in (key, longer))


def test_values_of_a_very_long_word(spark):
    """A megabyte of assignments in one word gives values that together are about as long as it, with every value in place."""
    listed = "https://a.example/x?" + "&".join(f"key{k}=value-{k}" for k in range(50_000))
    chained = "=".join(f"part{k}" for k in range(100_000))
    kept = "password=Tr0ub4dor&3;x"
    docs = spark.createDataFrame([(1, listed), (2, chained), (3, kept), (4, "conn=Server:db01;Password=Xy9zAb8c?user=me-too#token=qwer")], "doc_id bigint, text string")
    rows = secret_scan.candidates(docs).select("doc_id", "key", "candidate").collect()
    by = {d: {r.candidate for r in rows if r.doc_id == d} for d in range(1, 5)}
    assert len(listed) > 1_000_000 and len(chained) > 800_000
    assert by[1] >= {f"value-{k}" for k in range(50_000)} and sum(map(len, by[1])) < 3 * len(listed)
    assert by[2] >= {f"part{k}" for k in range(2, 100_000)} and sum(map(len, by[2])) < 3 * len(chained)
    assert "Tr0ub4dor&3;x" in by[3] and by[4] >= {"Server:db01", "db01", "Xy9zAb8c", "me-too", "qwer"}
