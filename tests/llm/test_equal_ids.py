"""Rows that share an id and have different texts."""

import random

import corpus_pipeline
from sievekit.llm import near_dedup, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)


def words(n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(d, " ".join(w), "en", "s", 9) for d, w in rows], SCHEMA)


def test_substring_dedup_of_a_long_and_a_short_text(spark):
    passage, short, mid = words(60), words(3), words(70)
    long = words(400) + passage
    rows = [(1, words(5) + passage), (2, long), (2, short), (2, mid + passage[:55])]
    got = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    kept = {(r["doc_id"], r["kept_text"]) for r in got}
    assert kept == {(1, " ".join(rows[0][1])), (2, " ".join(long[:400])), (2, " ".join(short)), (2, " ".join(mid))}


def test_near_links_of_both_texts_of_an_id(spark):
    a, b, other = words(200), words(300), words(50)
    near_a, near_b = a[:-1] + ["x"], b[:-1] + ["y"]
    rows = [(5, a), (5, b), (5, other), (7, near_a), (8, near_b), (3, a[:-2] + ["z", "z"])]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    at = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)
    assert at == [(3, 196, 3, True), (5, 46, 5, True), (5, 196, 3, False), (5, 296, 5, True),
                  (7, 196, 3, False), (8, 296, 5, False)]
    kept = corpus_pipeline.near_dedup_stage(spark, frame(spark, rows), "").collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(d, " ".join(w)) for d, w in (rows[5], rows[1], rows[2])}


def test_near_copies_under_one_id_stay_once(spark):
    a = words(200)
    rows = [(5, a), (5, a[:-1] + ["x"]), (None, a), (None, a[:-1] + ["x"])]
    got = corpus_pipeline.near_dedup_stage(spark, frame(spark, rows), "").collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 5]
