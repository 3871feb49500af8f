"""Registered queries against their SQL. A core set by default, all with ALL_QUERIES=1."""

import os

import pytest

from workload import ORACLES, QUERIES
from workload.compare import connect, difference

CORE = [
    "label_frequency", "label_pairs", "min_support_filter", "pair_stats", "top_color", "tone_distribution",
    "vision_text", "vision_web", "vision_faces", "phrase_bigrams", "apply_phrases", "lemma_pos_filter",
    "doc_freq_filter", "short_and_dup_filter", "parse_mapping_lines", "map_major_topic", "dedupe_keep_first",
    "stratified_split", "three_way_split", "prf_per_class", "confusion_matrix", "tfidf_word", "chi2_scores",
    "ctfidf_keywords", "topic_coherence", "approx_topic_distribution", "csv_scan", "csv_scan_encodings",
    "json_dir_scan", "incremental_ingest", "write_by_topic",
]
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None
