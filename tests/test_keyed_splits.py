import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from galleryloom.operators import collate, evaluate, features, keyed, splits


def rank_key(name, seed=42):
    return hashlib.md5(f"{seed}|{name}".encode()).hexdigest() + "|" + name


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_lookup_join(spark, monkeypatch, how):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(600)]
    counts = Counter(k for _, k in rows)
    left = spark.createDataFrame(rows, "id int, k string")
    table = [(k, n, k.upper()) for k, n in counts.items() if k != "k7"]
    lookup = spark.createDataFrame(table, "k string, n bigint, v string")
    want = {tuple(r) for r in left.join(lookup, "k", how).collect()}
    monkeypatch.setattr(keyed, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(keyed, "HOT_KEYS", 10)
    got = keyed.join_lookup(left, lookup, "k", how, load="n", spread="id")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_carry_forward_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(keyed, "CARRY_BLOCK", 4)
    rng = random.Random(1)
    rows = [(g, i * 3, rng.choice([None, None, i])) for g in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, n int, v int")
    for inclusive in (True, False):
        got = {(r.g, r.n): r.c for r in keyed.carry_forward(df, ["g"], "n", "v", "c", inclusive).collect()}
        for g in range(3):
            last = None
            for _, n, v in (r for r in rows if r[0] == g):
                before = last
                last = v if v is not None else last
                assert got[(g, n)] == (last if inclusive else before)


def split_of(df):
    return {r.image_name: r.split for r in df.collect()}


def images(spark, sizes):
    rows = [(f"img_{c}_{i}", c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "image_name string, label string")


def test_random_split_matches_the_ranking(spark):
    df = images(spark, {"a": 57})
    got = split_of(splits.random_split(df, "image_name"))
    order = sorted(got, key=rank_key)
    assert {n for n, s in got.items() if s == "test"} == set(order[: math.ceil(0.2 * 57)])
    assert split_of(splits.random_split(df.repartition(7), "image_name")) == got


def test_stratified_split_shares(spark):
    sizes = {"a": 333, "b": 41, "c": 7, "d": 2}
    got = split_of(splits.train_test_split(images(spark, sizes), "image_name", "label"))
    total = sum(sizes.values())
    tests = Counter(n.split("_")[1] for n, s in got.items() if s == "test")
    assert len(got) == total and sum(tests.values()) == math.ceil(0.2 * total)
    for c, n in sizes.items():
        assert abs(tests[c] - 0.2 * n) <= 1.01
        order = sorted((x for x in got if x.split("_")[1] == c), key=rank_key)
        assert {x for x in order if got[x] == "test"} == set(order[: tests[c]])


def test_single_rows_fall_back_to_random(spark):
    df = images(spark, {"a": 10, "b": 1})
    assert not splits.can_stratify(df, "label")
    assert Counter(split_of(splits.train_test_split(df, "image_name", "label")).values())["test"] == 3


def test_three_way_shares(spark):
    counts = Counter(split_of(splits.three_way_split(images(spark, {"a": 900}), "image_name")).values())
    assert counts == {"train": 720, "test": 100, "val": 80}


def test_first_row_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    got = {r.k: (r.v, r.copies) for r in collate.dedupe_keep_first(df, ["k"], ["o"], "copies").collect()}
    assert got == {"a": ("y", 2), "b": ("z", 1)}


def test_mapping_first_claim_wins(spark):
    inverted = collate.invert_mapping(collate.mapping_table(spark, {1: [0, 1, 2], 2: [2, 3]}))
    assert {r.small: r.major for r in inverted.collect()} == {0: 1, 1: 1, 2: 1, 3: 2}
    assert [(r.small, r.claimants) for r in collate.duplicate_claims(inverted).collect()] == [(2, [1, 2])]
    default = {r.small for r in collate.invert_mapping(collate.mapping_table(spark)).collect()}
    assert len(default) == 101 and set(range(108)) - default == {16, 27, 34, 47, 66, 93, 106}


def test_mapping_lines_modes(spark):
    lines = ["1. City", "0, 36, 55", "", "2. Food", "note", "8,19", "8"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, line_no int, text string")

    def run(mode):
        parsed = collate.mapping_from_lines(collate.parse_mapping_lines(df, ["doc"], mode), ["doc"])
        return {r.major: r.smalls for r in parsed.collect()}

    assert run("table") == {1: [0, 36, 55], 2: [8, 19]}
    assert run("paragraph") == {1: [0, 36, 55]}


def test_topic_ids_and_given_probabilities(spark):
    df = spark.createDataFrame([("topic_23",), ("-1",), ("none",), (None,)], "t string")
    assert [r.x for r in df.select(collate.parse_topic_id("t").alias("x")).collect()] == [23, -1, None, None]
    wide = spark.createDataFrame([("a", 0.2, 0.4, 0.4), ("b", 0.9, 0.1, 0.0)], "image_name string, topic_3 double, topic_5 double, topic_7 double")
    topic, prob = collate.dominant_columns(wide)
    assert [tuple(r) for r in wide.select(topic, prob).collect()] == [(5, 0.4), (3, 0.9)]
    given = spark.createDataFrame([("topic_4", "x"), ("7", "0.5")], "dominant_topic string, dominant_prob string")
    topic, prob = collate.dominant_columns(given)
    assert [tuple(r) for r in given.select(topic, prob).collect()] == [(4, None), (7, 0.5)]


def test_labels_sort_as_text(spark):
    df = spark.createDataFrame([(10,), (2,), (1,), (10,)], "label int")
    assert {r["label"]: r["index"] for r in features.label_index(df, "label").collect()} == {"1": 0, "10": 1, "2": 2}


def test_metrics_with_a_class_never_true(spark):
    rows = [("a", "a"), ("a", "x"), ("b", "b"), ("b", "a")]
    counts = evaluate.confusion_counts(spark.createDataFrame(rows, "true string, pred string"))
    per = {r.label: (r.precision, r.recall, r.f1, r.support) for r in evaluate.prf_per_class(counts).collect()}
    assert per == {"a": (0.5, 0.5, 0.5, 2), "b": (1.0, 0.5, 2 / 3, 2), "x": (0.0, 0.0, 0.0, 0)}
    cells = {(r.true, r.pred): r.n for r in evaluate.confusion_matrix(counts).collect()}
    assert len(cells) == 9 and cells[("x", "x")] == 0 and sum(cells.values()) == 4
    wide = evaluate.confusion_matrix_wide(counts, ["a", "b", "x"]).collect()
    assert [tuple(r) for r in wide] == [("a", 1, 0, 1), ("b", 1, 1, 0), ("x", 0, 0, 0)]
    params = evaluate.evaluation_report(spark.createDataFrame(rows, "true string, pred string"), {"c": 5}).where("scope = 'params'")
    assert params.first().text == "5"


def test_hot_keys_beyond_the_broadcast_bound(spark, monkeypatch):
    """One token holds half of the rows, another is hot but unknown to the lookup, a third of the keys is NULL."""
    rows = [(i, "hot" if i % 2 else None if i % 3 == 0 else "unknown" if i % 5 else f"k{i}") for i in range(600)]
    left = spark.createDataFrame(rows, "id int, k string")
    lookup = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(600)]], "k string, v int")
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(tuple, left.join(lookup, "k", how).select("id", "k").collect()), key=repr)
        monkeypatch.setattr(keyed, "BROADCAST_ROWS", 10)
        monkeypatch.setattr(keyed, "HOT_KEYS", 20)
        got = keyed.join_lookup(left, lookup, "k", how, spread="id", all_keys=True)
        assert sorted(map(tuple, got.select("id", "k").collect()), key=repr) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in plan
        monkeypatch.undo()
    with monkeypatch.context() as m:
        m.setattr(keyed, "BROADCAST_ROWS", 10)
        with pytest.raises(ValueError):
            keyed.join_lookup(left, lookup, "k")


def test_three_way_split_counts_an_image_once(spark):
    once = images(spark, {"a": 900})
    twice = split_of(splits.three_way_split(once.union(once.limit(300)), "image_name"))
    assert twice == split_of(splits.three_way_split(once, "image_name"))


@pytest.mark.parametrize("bins, few", [(64, 2), (4096, 10_000)])
def test_quantile_is_exact(spark, bins, few):
    draw = random.Random(3)
    groups = {
        "a": [draw.gauss(0, 1e-3) for _ in range(400)], "b": [draw.choice([1.0, 1.0, 2.0]) for _ in range(300)], "c": [7.5], "d": [None, None],
        "e": [10.0 ** draw.randint(-300, 300) for _ in range(200)] + [None] * 9, "f": [-1.5] * 50 + [0.0, 3.0], "g": [1e308, -1e308, 0.0, 5.0, 6.0],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    for q in (0.5, 0.95):
        got = {r.g: (r.n, r["limit"]) for r in keyed.quantile_values(df, "g", "x", q, "x", bins, few).collect()}
        for g, xs in groups.items():
            known = sorted(x for x in xs if x is not None)
            want = known[max(math.ceil(q * len(known)), 1) - 1] if known else None
            assert got[g] == (len(xs), want), (g, q)
