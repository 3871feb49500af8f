import random

import duckdb
import pytest
from galleryloom.llm import licenses as lic
from galleryloom.llm.common import table
from workload.compare import connect, difference


def digest(spark, folder, rows):
    path = str(folder / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, licenses string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return lic.op11_license_scan(spark, str(folder)), con


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf, size):
    folder = sf.replace("sf0.001", size)
    con = connect(folder)
    assert difference(lic.op11_license_scan(spark, folder), con, lic.oracle()) is None


def test_planted_notices(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    notes = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "GNU General Public License, version 3.": "gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "All rights reserved.": "reserved",
    }
    for row in lic.op11_license_scan(spark, folder).collect():
        want = {label for note, label in notes.items() if note in texts[row.doc_id]}
        assert want == set(filter(None, row.labels.split(","))) - {"gpl", "cc-by"}, (row, want)


def test_edges_equal_sql(spark, tmp_path):
    note = lic.NOTICES[4].text
    rows = [
        (1, None), (2, ""), (3, "?! .."), (4, "CC BY"), (5, "cc-by cc by, cc\nBY" * 3), (5, "cc-by cc by, cc\nBY" * 3), (None, "All RIGHTS reserved. é all rights réserved"),
        (6, note.upper()), (7, note.replace("this software", "this fine software")), (8, "under the " * 9 + "MIT, of course, License"), (9, "general public" + " filler" * 20_000 + " general public license " * 500),
        (10, "licensed under gnu lesser general public license"), (11, "apache apache license license version 2.0 apache license version 2 0"), (12, "mit license"),
        (13, "license mit under the released"), (14, "released under the well known and rather old mit license"),
    ]
    query, con = digest(spark, tmp_path, [(i, t, "x") for i, t in rows])
    assert difference(query, con, lic.oracle()) is None
    got = {r.doc_id: r for r in query.collect()}
    assert (got[1].n_words, got[1].labels, got[1].first_word, got[1].score) == (0, "", None, 0.0)
    assert (got[9].n_base, got[9].first_word, got[9].last_word) == (500, 20_002, 20_002 + 3 * 499)
    assert got[4].labels == "cc-by" and got[4].score == 1.0 and got[6].labels == got[7].labels == "mit" and got[13].labels == ""
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lic.with_licenses(empty, lic.build_index(empty)).count() == 0


def test_random_texts_equal_sql(spark, tmp_path):
    draw = random.Random(5)
    words = sorted({w for t in lic.TEMPLATES for w in t.text.split()}) + ["x", "y", "z"]
    rows = []
    for i in range(400):
        parts = []
        for _ in range(draw.randint(0, 6)):
            part = draw.choice(lic.TEMPLATES).text.split() if draw.random() < 0.7 else draw.choices(words, k=draw.randint(1, 8))
            parts += [w for w in part if draw.random() > 0.08] if draw.random() < 0.6 else part
            parts += draw.choices(words, k=draw.randint(0, 3))
        rows.append((i, " ".join(parts), "x"))
    query, con = digest(spark, tmp_path, rows)
    assert difference(query, con, lic.oracle()) is None
    assert query.where("labels <> base_labels").count() > 50


def test_templates_are_checked(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        lic.build_index(docs, (lic.Template("l", "some words", ("other words",)),))
    assert lic.Index((lic.Template("l", ""),), {}).places([b"a"]) == []
