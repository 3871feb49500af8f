"""Annotation documents are parsed once, whatever the optimizer moves."""

from pyspark.sql import functions as F

from galleryloom.functions.annotations import parse_documents
from galleryloom.operators import colors, vision
from workload import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def documents(spark, *texts):
    return parse_documents(spark.createDataFrame([(t,) for t in texts], "json string"), "json")


def test_sections_are_parsed_once(spark, sf):
    for name in ("vision_text", "vision_landmarks", "vision_logos", "vision_objects", "vision_crops", "vision_faces", "vision_document"):
        assert plan(QUERIES[name](spark, sf)).count("parseJson") == 1, name


def test_tones_are_parsed_once(spark, sf):
    assert plan(QUERIES["tone_labels"](spark, sf)).count("parseJson") == 1


def test_matrix_reads_stored_sets(spark, sf):
    assert "parseJson" not in plan(QUERIES["cooccurrence_matrix"](spark, sf))


def test_items_of_odd_sections(spark):
    docs = documents(
        spark, '{"image_name":"a","label_annotations":[{"description":"x","score":1},null]}', '{"image_name":"b","label_annotations":[]}',
        '{"image_name":"c"}', '\t\r\n {"image_name":"d","label_annotations":[{"description":"y"}]}', 'x {"image_name":"e"}', '{"image_name":"f"} {}', None, "",
    )
    rows = vision.section_items(vision.normalize_annotations(docs, ["labels"]), "labels").select("image_name", "e.*").collect()
    assert sorted(map(tuple, rows), key=str) == [("a", "x", 1.0), ("a", None, None), ("d", "y", None)]


def test_words_of_documents_without_levels(spark):
    word = '{"symbols":[{"text":"h"},{"text":"i"}],"confidence":0.5}'
    pages = f'[{{"blocks":[]}},{{}},{{"blocks":[{{"block_type":2,"paragraphs":[{{"words":[]}},{{"words":[{word},null]}}]}}]}}]'
    docs = documents(spark, f'{{"image_name":"a","full_text_annotation":{{"pages":{pages}}}}}', '{"image_name":"b","full_text_annotation":{"text":"t"}}', '{"image_name":"c"}')
    normalized = vision.normalize_annotations(docs, ["document_text_annotation"])
    words = vision.document_words(normalized).collect()
    assert [(r.image_name, r.page_no, r.block_no, r.block_type, r.paragraph_no, r.word_no, r.word) for r in words][0] == ("a", 2, 0, "TABLE", 1, 0, "hi")
    assert [(r.word_no, r.confidence) for r in words] == [(0, 0.5), (1, None)]
    assert [r.p for r in normalized.orderBy("image_name").select(F.col("document_text_annotation.text").alias("p")).collect()] == [None, "t", None]


def test_tone_shares(spark):
    color = '{"image_properties":{"dominant_colors":[{"color":{"red":%d}}]}}'
    docs = documents(spark, color % 255, color % 255, color % 0, '{"image_properties":"none"}', None)
    tones = colors.tone_distribution(colors.with_tone(colors.top_colors(docs)))
    assert sorted((r.tone, r["count"], round(r.fraction, 6)) for r in tones.collect()) == [("Black", 1, 0.333333), ("Red", 2, 0.666667)]
