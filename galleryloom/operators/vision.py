"""Normalise raw image-annotation responses: one VARIANT parse, one typed cast per requested section.

Absent or empty sections become NULL (never a sentinel text), so every output column has one type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleryloom.functions.annotations import field, member

# Enumeration names by ordinal.
LIKELIHOODS = ["UNKNOWN", "VERY_UNLIKELY", "UNLIKELY", "POSSIBLE", "LIKELY", "VERY_LIKELY"]
BLOCK_TYPES = ["UNKNOWN", "TEXT", "TABLE", "PICTURE", "RULER", "BARCODE"]
BREAK_TYPES = ["UNKNOWN", "SPACE", "SURE_SPACE", "EOL_SURE_SPACE", "HYPHEN", "LINE_BREAK"]
FACE_LANDMARKS = [
    "UNKNOWN_LANDMARK", "LEFT_EYE", "RIGHT_EYE", "LEFT_OF_LEFT_EYEBROW", "RIGHT_OF_LEFT_EYEBROW",
    "LEFT_OF_RIGHT_EYEBROW", "RIGHT_OF_RIGHT_EYEBROW", "MIDPOINT_BETWEEN_EYES", "NOSE_TIP", "UPPER_LIP",
    "LOWER_LIP", "MOUTH_LEFT", "MOUTH_RIGHT", "MOUTH_CENTER", "NOSE_BOTTOM_RIGHT", "NOSE_BOTTOM_LEFT",
    "NOSE_BOTTOM_CENTER", "LEFT_EYE_TOP_BOUNDARY", "LEFT_EYE_RIGHT_CORNER", "LEFT_EYE_BOTTOM_BOUNDARY",
    "LEFT_EYE_LEFT_CORNER", "RIGHT_EYE_TOP_BOUNDARY", "RIGHT_EYE_RIGHT_CORNER", "RIGHT_EYE_BOTTOM_BOUNDARY",
    "RIGHT_EYE_LEFT_CORNER", "LEFT_EYEBROW_UPPER_MIDPOINT", "RIGHT_EYEBROW_UPPER_MIDPOINT",
    "LEFT_EAR_TRAGION", "RIGHT_EAR_TRAGION", "LEFT_EYE_PUPIL", "RIGHT_EYE_PUPIL", "FOREHEAD_GLABELLA",
    "CHIN_GNATHION", "CHIN_LEFT_GONION", "CHIN_RIGHT_GONION", "LEFT_CHEEK_CENTER", "RIGHT_CHEEK_CENTER",
]

# SQL types of the response sections.
_POINTS = "array<struct<x:int,y:int>>"
_POLY = f"struct<vertices:{_POINTS}>"
_LANGUAGES = "detected_languages:array<struct<language_code:string,confidence:double>>"
_BREAK = "detected_break:struct<type:string,is_prefix:boolean>"
_PROPERTY = f"property:struct<{_LANGUAGES},{_BREAK}>,bounding_box:{_POLY},confidence:double"
_SYMBOL = f"struct<{_PROPERTY},text:string>"
_WORD = f"struct<{_PROPERTY},symbols:array<{_SYMBOL}>>"
_PARAGRAPH = f"struct<{_PROPERTY},words:array<{_WORD}>>"
_BLOCK = f"struct<{_PROPERTY},block_type:string,paragraphs:array<{_PARAGRAPH}>>"
_PAGE = f"struct<property:struct<{_LANGUAGES}>,width:int,height:int,blocks:array<{_BLOCK}>>"
_FACE_LIKELIHOODS = ["joy", "sorrow", "anger", "surprise", "under_exposed", "blurred", "headwear"]
_URLS = "array<struct<url:string>>"


def enum_name(value: Column, names: list[str]) -> Column:
    """Name of an enumeration value given by ordinal; names pass through."""
    ordinals = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(str(i)), F.lit(n))])
    return F.coalesce(F.element_at(ordinals, value), value)


def _filled(items: Column) -> Column:
    """NULL for an empty list. A filter over a list of one, since a condition would evaluate the items twice."""
    return F.get(F.filter(F.array(items), lambda x: F.size(x) > 0), F.lit(0))


def _present(value: Column, body) -> Column:
    """`body` of a value that is not NULL, which is evaluated once."""
    return F.get(F.transform(F.filter(F.array(value), lambda x: x.isNotNull()), body), F.lit(0))


def _points(poly: Column, name: str = "vertices", data_type: str = _POINTS) -> Column:
    return F.coalesce(poly[name], F.array().cast(data_type))


def text_annotations(doc: Column) -> Column:
    items = field(doc, "text_annotations", f"array<struct<description:string,bounding_poly:{_POLY},score:double>>")
    return _filled(
        F.transform(
            items,
            lambda t: F.struct(
                t["description"].alias("description"),
                F.struct(_points(t["bounding_poly"]).alias("vertices")).alias("bounding_poly"),
                F.coalesce(t["score"], F.lit(0.0)).alias("score"),
            ),
        )
    )


def _property(node: Column, with_break: bool = True) -> Column:
    empty = F.array().cast("array<struct<language_code:string,confidence:double>>")
    parts = [F.coalesce(node["property"]["detected_languages"], empty).alias("detected_languages")]
    if with_break:
        mark = node["property"]["detected_break"]
        named = F.struct(
            enum_name(mark["type"], BREAK_TYPES).alias("type"), mark["is_prefix"].alias("is_prefix")
        )
        parts.append(F.when(mark.isNotNull(), named).alias("detected_break"))
    return F.struct(*parts).alias("property")


def _level(child: str | None, convert, *extra):
    """Converter of one text level: property, box, confidence, plus its own fields and children."""

    def apply(node: Column) -> Column:
        parts = [_property(node), _points(node["bounding_box"]).alias("bounding_box"), node["confidence"].alias("confidence")]
        parts += [make(node).alias(name) for name, make in extra]
        if child:
            parts.append(F.transform(node[child], convert).alias(child))
        return F.struct(*parts)

    return apply


def document_text(doc: Column) -> Column:
    """Full text with pages, blocks, paragraphs, words and symbols."""
    symbol = _level(None, None, ("text", lambda s: s["text"]))
    word = _level("symbols", symbol)
    paragraph = _level("words", word)
    block = _level("paragraphs", paragraph, ("block_type", lambda b: enum_name(b["block_type"], BLOCK_TYPES)))

    def page(node: Column) -> Column:
        return F.struct(
            _property(node, with_break=False),
            node["width"].alias("width"),
            node["height"].alias("height"),
            F.transform(node["blocks"], block).alias("blocks"),
        )

    raw = field(doc, "full_text_annotation", f"struct<text:string,pages:array<{_PAGE}>>")
    return _present(raw, lambda r: F.struct(r["text"].alias("text"), F.transform(r["pages"], page).alias("pages")))


def landmarks(doc: Column) -> Column:
    items = field(
        doc,
        "landmark_annotations",
        "array<struct<description:string,score:double,"
        f"locations:array<struct<lat_lng:struct<latitude:double,longitude:double>>>,bounding_poly:{_POLY}>>",
    )
    none = F.array().cast("array<struct<latitude:double,longitude:double>>")
    return _filled(
        F.transform(
            items,
            lambda m: F.struct(
                m["description"].alias("description"),
                m["score"].alias("score"),
                F.coalesce(
                    F.transform(
                        m["locations"],
                        lambda p: F.struct(
                            p["lat_lng"]["latitude"].alias("latitude"), p["lat_lng"]["longitude"].alias("longitude")
                        ),
                    ),
                    none,
                ).alias("locations"),
                _points(m["bounding_poly"]).alias("bounding_poly"),
            ),
        )
    )


def logos(doc: Column) -> Column:
    items = field(doc, "logo_annotations", f"array<struct<description:string,score:double,bounding_poly:{_POLY}>>")
    return _filled(
        F.transform(
            items,
            lambda m: F.struct(
                m["description"].alias("description"),
                m["score"].alias("score"),
                _points(m["bounding_poly"]).alias("bounding_poly"),
            ),
        )
    )


def labels(doc: Column) -> Column:
    return _filled(field(doc, "label_annotations", "array<struct<description:string,score:double>>"))


def image_properties(doc: Column) -> Column:
    """Dominant colours; NULL without the section, an empty list when it names no colours.

    Alpha may be a number, a wrapped number (`{"value": …}`) or absent.
    """
    colors = field(doc, "image_properties_annotation.dominant_colors.colors", "array<variant>")
    present = field(doc, "image_properties_annotation", "variant").isNotNull()
    item_type = (
        "array<struct<color:struct<red:double,green:double,blue:double,alpha:double>,"
        "score:double,pixel_fraction:double>>"
    )

    def entry(c: Column) -> Column:
        alpha = F.coalesce(member(c, "color.alpha.value", "double"), member(c, "color.alpha", "double"))
        channels = [F.coalesce(member(c, f"color.{n}", "double"), F.lit(0.0)).alias(n) for n in ("red", "green", "blue")]
        return F.struct(
            F.struct(*channels, alpha.alias("alpha")).alias("color"),
            member(c, "score", "double").alias("score"),
            member(c, "pixel_fraction", "double").alias("pixel_fraction"),
        )

    listed = F.coalesce(F.transform(colors, entry).cast(item_type), F.array().cast(item_type))
    return F.when(present, F.struct(listed.alias("dominant_colors")))


def object_localizations(doc: Column) -> Column:
    points = "array<struct<x:double,y:double>>"
    items = field(
        doc,
        "localized_object_annotations",
        f"array<struct<name:string,score:double,bounding_poly:struct<normalized_vertices:{points}>>>",
    )
    return _filled(
        F.transform(
            items,
            lambda o: F.struct(
                o["name"].alias("name"),
                o["score"].alias("score"),
                F.struct(
                    _points(o["bounding_poly"], "normalized_vertices", points).alias("normalized_vertices")
                ).alias("bounding_poly"),
            ),
        )
    )


def crop_hints(doc: Column) -> Column:
    items = field(doc, "crop_hints_annotation.crop_hints", f"array<struct<bounding_poly:{_POLY},confidence:double>>")
    return _filled(
        F.transform(
            items,
            lambda c: F.struct(
                F.struct(_points(c["bounding_poly"]).alias("vertices")).alias("bounding_poly"),
                c["confidence"].alias("confidence"),
            ),
        )
    )


def web_detection(doc: Column) -> Column:
    """Six optional lists, each NULL when empty; NULL altogether when all are."""
    lists = {
        "web_entities": "array<struct<description:string,score:double>>",
        "full_matching_images": _URLS,
        "partial_matching_images": _URLS,
        "visually_similar_images": _URLS,
        "pages_with_matching_images": _URLS,
        "best_guess_labels": "array<struct<label:string,language_code:string>>",
    }
    raw = field(doc, "web_detection", "struct<" + ",".join(f"{n}:{t}" for n, t in lists.items()) + ">")

    def filled(r: Column) -> Column:
        has_items = F.lit(False)
        for n in lists:
            has_items = has_items | (F.size(F.coalesce(r[n], F.array().cast(lists[n]))) > 0)
        return F.when(has_items, F.struct(*[_filled(r[n]).alias(n) for n in lists]))

    return _present(raw, filled)


def safe_search(doc: Column) -> Column:
    names = ["adult", "spoof", "medical", "violence", "racy"]
    raw = field(doc, "safe_search_annotation", "struct<" + ",".join(f"{n}:string" for n in names) + ">")
    return _present(raw, lambda r: F.struct(*[enum_name(r[n], LIKELIHOODS).alias(n) for n in names]))


def faces(doc: Column) -> Column:
    """Confidence, likelihood names, face box (tight box if it has corners, else wide box), landmarks."""
    likelihoods = ",".join(f"{n}_likelihood:string" for n in _FACE_LIKELIHOODS)
    items = field(
        doc,
        "face_annotations",
        f"array<struct<detection_confidence:double,{likelihoods},fd_bounding_poly:{_POLY},bounding_poly:{_POLY},"
        "landmarks:array<struct<type:string,position:struct<x:double,y:double,z:double>>>>>",
    )

    def face(f: Column) -> Column:
        tight, wide = f["fd_bounding_poly"]["vertices"], f["bounding_poly"]["vertices"]
        box = F.coalesce(_filled(tight), _filled(wide), F.array().cast(_POINTS))
        marks = F.transform(
            f["landmarks"],
            lambda m: F.struct(enum_name(m["type"], FACE_LANDMARKS).alias("type"), m["position"].alias("position")),
        )
        return F.struct(
            f["detection_confidence"].alias("detection_confidence"),
            *[enum_name(f[f"{n}_likelihood"], LIKELIHOODS).alias(f"{n}_likelihood") for n in _FACE_LIKELIHOODS],
            box.alias("detection_bounding_box"),
            _filled(marks).alias("landmarks"),
        )

    return _filled(F.transform(items, face))


SECTIONS = {
    "text_annotations": text_annotations,
    "document_text_annotation": document_text,
    "landmarks": landmarks,
    "logos": logos,
    "labels": labels,
    "image_properties": image_properties,
    "object_localizations": object_localizations,
    "crop_hints": crop_hints,
    "web_detection": web_detection,
    "safe_search_properties": safe_search,
    "faces": faces,
}


def normalize_annotations(
    docs: DataFrame, sections: list[str] | None = None, document: str = "document", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per response with the requested typed sections; a narrow projection, no shuffle."""
    wanted = list(SECTIONS) if sections is None else sections
    return docs.select(
        *keep,
        field(document, "image_name", "string").alias("image_name"),
        *[SECTIONS[s](F.col(document)).alias(s) for s in wanted],
    )


def section_items(normalized: DataFrame, items: str | Column, out: str = "e") -> DataFrame:
    """(image_name, `out`): one row per item of a list section.

    The outer generator, whose rows of missing and empty lists are dropped by their position: for the inner
    one the optimizer moves a test of the list below the parsing and so repeats all of it several times.
    """
    rows = normalized.select("image_name", F.posexplode_outer(items).alias("_place", out))
    return rows.where(F.col("_place").isNotNull()).select("image_name", out)


def document_words(normalized: DataFrame) -> DataFrame:
    """Long form of the full text: one row per word with the numbers of its page, block and paragraph.

    Outer generators, as in `section_items`; a missing level leaves the word's number empty.
    """
    return (
        normalized.select("image_name", F.posexplode_outer("document_text_annotation.pages").alias("page_no", "page"))
        .select("image_name", "page_no", F.posexplode_outer("page.blocks").alias("block_no", "block"))
        .select(
            "image_name", "page_no", "block_no", F.col("block.block_type").alias("block_type"),
            F.posexplode_outer("block.paragraphs").alias("paragraph_no", "paragraph"),
        )
        .select(
            "image_name", "page_no", "block_no", "block_type", "paragraph_no",
            F.posexplode_outer("paragraph.words").alias("word_no", "word"),
        )
        .where(F.col("word_no").isNotNull())
        .select(
            "image_name", "page_no", "block_no", "block_type", "paragraph_no", "word_no",
            F.array_join("word.symbols.text", "").alias("word"),
            F.size("word.symbols").alias("symbols"),
            F.col("word.confidence").alias("confidence"),
        )
    )
