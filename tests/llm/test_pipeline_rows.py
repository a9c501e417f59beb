"""Stages of the pipeline on small hand-made corpora."""

import corpus_pipeline
from sievekit.sources.tables import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dedup_stage_at_80(spark):
    """One changed word of 64 leaves 55 of 65 shingles (0.846), two leave 50 of 70 (0.714)."""
    words = [f"w{i}" for i in range(64)]
    one, two = list(words), list(words)
    one[30] = "x"
    two[20] = two[40] = "y"
    rows = [(i, " ".join(w), "en", "s", 9) for i, w in enumerate([words, one, two])]
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert {r["doc_id"] for r in got} == {0, 2}


def test_a_null_in_any_column_but_the_text_removes_nothing(spark):
    docs = table(spark, SF, "documents").filter("lang = 'en'").select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
    clean = docs.orderBy("doc_id").limit(6).collect()
    assert len(clean) == 6
    rows = [tuple(r) for r in clean]
    for k, c in enumerate(corpus_pipeline.COLUMNS):
        if c != "text":
            rows[k] = tuple(None if n == c else v for n, v in zip(corpus_pipeline.COLUMNS, rows[k]))
    for given in (rows, [(d, t, None, s, n) for d, t, _, s, n in rows]):
        state = spark.createDataFrame(given, SCHEMA)
        for name, stage in corpus_pipeline.STAGES[:4]:
            state = corpus_pipeline.cut_lineage(stage(spark, state, SF))
            assert {r["text"] for r in state.collect()} == {r[1] for r in rows}, name
        packed = corpus_pipeline.STAGES[4][1](spark, state, SF)
        assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in rows}


def test_texts_without_letters_go_when_no_language_was_learned(spark):
    rows = [(1, "123 !!", None, "s", 6), (2, "some words", None, "s", 10), (3, "日本語", None, "s", 3), (4, None, None, "s", 0)]
    got = corpus_pipeline.language_stage(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert {r["doc_id"] for r in got} == {2, 3}
