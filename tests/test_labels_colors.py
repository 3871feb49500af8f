import colorsys
import itertools
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from galleryloom.functions.annotations import parse_documents
from galleryloom.operators import colors, labels
from galleryloom.operators.vision import normalize_annotations


def documents(spark, values):
    texts = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return parse_documents(spark.createDataFrame(texts, "k int, j string"), "j", ("k",))


def test_only_whole_objects_parse(spark):
    values = ['{"a":1}', ' {"a":1} ', '{"a":1} x', '{"a":1},{"b":1}', "[1]", '"a"', '{"a":', "", "null"]
    rows = documents(spark, values).select("k", F.col("document").isNotNull().alias("ok")).collect()
    assert {r.k: r.ok for r in rows} == {i: i < 2 for i in range(len(values))}


def test_label_items_sentinel_both_keys_and_unscored(spark):
    docs = documents(
        spark,
        [
            {"image_name": "a", "labels": "No labels detected."},
            {"image_name": "b", "labels": [{"description": "x"}, {"description": ""}], "labelAnnotations": [{"description": "y", "score": 0.5}]},
            {"labels": [{"description": "x"}, {"description": "x", "score": 0.25}]},
        ],
    )
    rows = {r.label: r for r in labels.label_frequency(labels.extract_labels(docs)).collect()}
    assert set(rows) == {"x", "y"}
    assert (rows["x"]["count"], rows["x"].image_count, rows["x"].avg_score, rows["x"].max_score) == (3, 2, 0.25 / 3, 0.25)
    assert (rows["y"]["count"], rows["y"].max_score) == (1, 0.5)


def test_never_scored_label_has_no_maximum(spark):
    docs = documents(spark, [{"image_name": "a", "labels": [{"description": "x"}]}])
    row = labels.label_frequency(labels.extract_labels(docs)).first()
    assert row.avg_score == 0.0 and row.max_score is None


def test_label_sets_of_mixed_items(spark):
    docs = documents(
        spark,
        [
            {"labels": ["Beach", " Sea ", {"label": "Sun", "score": 0.9}, {"name": "Low", "score": 0.1}, 5]},
            {"labels": "No labels detected."},
            {"labels": [{"description": "", "label": "", "name": "N"}, {"description": "  "}]},
        ],
    )
    got = {r.k: r["labels"] for r in labels.label_sets(docs, threshold=0.5, keep=("k",)).collect()}
    assert got == {0: ["Beach", "Sea", "Sun"], 1: [], 2: ["N"]}


@pytest.mark.parametrize("chunk", [256, 2])
def test_pairs_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(labels, "SET_CHUNK", chunk)
    sets = [["a", "b", "c", "d", "e"], ["a", "b"], ["a", "b"], ["c"], [], ["b", "e", "f"]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "k int, labels array<string>")
    want = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    got = {(r.label_a, r.label_b): r.co_occurrence for r in labels.label_pairs(df).collect()}
    assert got == dict(want)
    counts = labels.label_image_counts(df)
    for r in labels.pair_stats(labels.label_pairs(df), counts).collect():
        assert 0 < r.p_b_given_a <= 1 and 0 < r.p_a_given_b <= 1
    wide = labels.cooccurrence_matrix(labels.label_pairs(df), counts, list("abcdef")).collect()
    matrix = {r.row_label: r.asDict() for r in wide}
    single = {r.label: r.images for r in counts.collect()}
    for a in "abcdef":
        assert matrix[a][a] == single[a]
        for b in "abcdef":
            assert matrix[a][b] == matrix[b][a]


def test_min_support_before_pairs(spark):
    sets = [["a", "b", "rare"], ["a", "b"], ["a"]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "k int, labels array<string>")
    kept = {r.k: r["labels"] for r in labels.with_min_support(df, "k", 2).collect()}
    assert kept == {0: ["a", "b"], 1: ["a", "b"], 2: ["a"]}


def tone_of(rgb):
    h, s, v = colorsys.rgb_to_hsv(*[c / 255.0 for c in rgb])
    if v < 0.15:
        return "Black"
    if s < 0.12:
        return "White" if v > 0.85 else "Gray"
    degrees = h * 360.0
    if degrees >= 345:
        return "Red"
    names = ["Red", "Orange", "Yellow", "Green", "Cyan", "Blue", "Purple", "Pink"]
    return names[sum(degrees >= e for e in (15, 45, 65, 150, 210, 270, 300))]


def test_tones_on_a_colour_grid(spark):
    steps = list(range(0, 256, 15))
    grid = list(itertools.product(steps, steps, steps))
    df = spark.createDataFrame(grid, "red int, green int, blue int")
    wrong = [r for r in colors.with_tone(df).collect() if r.tone != tone_of((r.red, r.green, r.blue))]
    assert wrong == []


def test_top_color_paths(spark):
    def raw(entry):
        return {"imagePropertiesAnnotation": {"dominantColors": {"colors": [entry]}}}

    docs = documents(
        spark,
        [
            {"image_properties": {"dominant_colors": [{"color": {"red": 10.9, "blue": 3}}]}},
            raw({"color": {"green": 7}}),
            {"image_properties": {"dominant_colors": [{"score": 1}]}},
            {"image_properties": "No image properties detected."},
            {"image_properties": {"dominant_colors": []}, **raw({"color": {"red": 1}})},
            {"image_properties": {"dominant_colors": ["text"]}},
        ],
    )
    got = {r.k: (r.red, r.green, r.blue) for r in colors.top_colors(docs, keep=("k",)).collect()}
    assert got == {0: (10, 0, 3), 1: (0, 7, 0), 2: (0, 0, 0), 4: (1, 0, 0)}


def test_absent_sections_are_null(spark):
    docs = documents(spark, [{"image_name": "a", "web_detection": {"web_entities": []}, "face_annotations": "none"}])
    row = normalize_annotations(docs).first()
    assert row.image_name == "a"
    assert all(row[c] is None for c in row.asDict() if c != "image_name")


def test_matrix_in_long_form_has_zeros(spark):
    sets = spark.createDataFrame([("1", ["a", "b"]), ("2", ["b"]), ("3", ["c"]), ("4", ["a", "b"])], "doc_key string, labels array<string>")
    cells = labels.cooccurrence_filled(labels.label_pairs(sets), labels.label_image_counts(sets)).collect()
    got = {(r.row_label, r.col_label): r.images for r in cells}
    assert len(cells) == 9 and got == {
        ("a", "a"): 2, ("a", "b"): 2, ("a", "c"): 0, ("b", "a"): 2, ("b", "b"): 3, ("b", "c"): 0, ("c", "a"): 0, ("c", "b"): 0, ("c", "c"): 1
    }
    assert labels.cooccurrence_filled(labels.label_pairs(sets.limit(0)), labels.label_image_counts(sets.limit(0))).count() == 0
