import re

from pyspark.sql import functions as F

from sightline.llm.licenses import LIMIT, TEMPLATES, _sql, bigrams, needles, scan_licenses


def brute(text):
    best = (0.0, 0, 0)
    for unit in (text or "").split("\n") + re.split(r"\n[ \t\r]*\n", text or ""):
        a = set(bigrams(unit))
        for j, (_, body) in enumerate(TEMPLATES):
            b = set(bigrams(body))
            best = max(best, (2.0 * len(a & b) / (len(a) + len(b)), len(b), -j))
    return (TEMPLATES[-best[2]][0], best[0]) if best[0] >= LIMIT else (None, None)


def test_scan(spark):
    mit = TEMPLATES[3][1]
    texts = [None, "", "plain text\nwith lines", "x\nReleased under the MIT license", "LICENSED UNDER THE apache license version 2.0!\nfoo", "a\n\n" + re.sub("(.{60}) ", r"\1\n", mit) + "\n\nb", "one", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", mit[:300], "é Released  under\tthe MIT License. ñ"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("dice", F.lit("clash"))
    got = {r.doc_id: (r.license, r.dice) for r in scan_licenses(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert got[3][0] == "MIT" and got[5][0] == "MIT" and got[4][0] == "Apache-2.0" and got[2] == (None, None)
    assert scan_licenses(df.limit(0)).count() == 0


def test_notices_across_blank_lines_and_within_lines(spark):
    apache = TEMPLATES[1][1].replace(" You may obtain", "\nYou may obtain").replace(" at http:", " at\n\n    http:").replace("2.0 Unless", "2.0\n\nUnless")
    assert apache.count("\n\n") == 2
    texts = [
        "# Copyright 2020 Foo\n#\n" + re.sub("(?m)^", "# ", apache) + "\n\nimport os",
        apache,
        "Copyright 2020 Foo. Licensed under the Apache License, Version 2.0. All rights reserved.",
        "The code is released under the MIT License, see the file LICENSE for details.",
        "by the MIT License.",
        "We were released under the bridge, with more words about the apache license than needed.",
    ]
    assert all(brute(t) == (None, None) for t in (texts[1], *texts[2:]))
    got = {r.doc_id: (r.license, r.dice) for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("Apache-2.0", 1.0), 1: ("Apache-2.0", 1.0), 2: ("Apache-2.0", 1.0), 3: ("MIT", 1.0), 4: (None, None), 5: (None, None)}


def test_whole_texts_ties_repeats_and_a_very_long_text(spark):
    full = [b for _, b in TEMPLATES]
    rows = [(i, "intro line\n\n" + re.sub("(.{50}) ", r"\1\n", b) + "\n\nthe end") for i, b in enumerate(full)]
    rows += [(100, rows[4][1]), (100, rows[4][1]), (101, "und so weiter " * 50_000 + "\nReleased under the MIT License.\n" + "foo bar " * 50_000), (102, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.license, r.dice))
    for i, (name, body) in enumerate(TEMPLATES):
        assert by[i] == [(name, 1.0)], (i, name, by[i])
    assert by[100] == [("MIT", 1.0)] * 2 and by[101] == [("MIT", 1.0)]
    assert by[102] == [("CC-BY-NC-4.0", 1.0)]  # both are whole: the larger one


def test_every_match_holds_a_needle():
    """Also the worst: a template without all bigrams that the limit lets go."""
    found = needles(TEMPLATES, LIMIT)
    for _, body in TEMPLATES:
        own = bigrams(body)
        touched = [g for g in own if any(f" {k} " in f" {g} " for k in found)]
        assert 2 * (len(own) - len(touched)) / (2 * len(own) - len(touched)) < LIMIT


def test_documents_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.execute(_sql()).fetchall(), key=str)
    got = scan_licenses(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_columns_of_any_name(spark):
    names = ("_text", "_plain", "_padded", "_may_hit", "_units", "_sets", "_words", "_starts", "_windows", "_best", "_c0", "license")
    df = spark.createDataFrame([("plain text",), (None,)], "text string").select("text", *(F.lit("own").alias(c) for c in names))
    out = scan_licenses(df)
    assert out.count() == 2 and all(r[c] == "own" for r in out.collect() for c in names[:-1]) and {r.license for r in out.collect()} == {None}
