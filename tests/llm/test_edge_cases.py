"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, per operator and stage."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievekit.llm import (language_id, licenses, lm_scoring, near_dedup, packing, quality, sharding, spotsigs,
                          substring_dedup, word_bpe)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, n_words string, score string"
PASSAGE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, None, None, None, None, "x", "y", "z"),
    (2, "", "en", "s", 0, "x", "y", "z"),
    (3, " \t\n ", "en", "s", 4, None, None, None),
    (4, "start here " + PASSAGE + " the end of it", "en", "s", 9, "x", "y", "z"),
    (5, "start here " + PASSAGE + " the end of it", "en", "s", 9, "x", "y", "z"),
    (6, "another beginning\n" + PASSAGE, "en", None, 9, "x", "y", "z"),
    (6, "another beginning\n" + PASSAGE, "en", None, 9, "x", "y", "z"),
    (7, "le chat et la souris dans la maison " * 3000, "fr", "s", 9, "x", "y", "z"),
    (8, "Licensed under the Apache License, Version 2.0.\nAll rights reserved, CC BY.", "en", "s", 9, "x", "y", "z"),
    (9, "123 456 !!", None, "s", 9, "x", "y", "z"),
    (10, "日本語 テキスト <|endoftext|> é  x", "ja", "s", 9, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_sharding(odd, none):
    w = [1.0, 2.0, 1.0]
    got = by_id(sharding.assign(odd, "doc_id", w))
    grown = by_id(sharding.assign(odd, "doc_id", [*w, 1.0]))
    assert set(got) == {r[0] for r in ROWS} and all(0 <= r["shard"] < 3 for r in got.values())
    assert all(grown[k]["shard"] in (got[k]["shard"], 3) for k in got)
    assert sharding.assign(none, "doc_id", w).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(odd, "doc_id", [1.0, 0.0])


def test_sharding_follows_weights(spark):
    n = sharding.assign(spark.range(20000).withColumnRenamed("id", "k"), "k", [1.0, 3.0]).filter("shard = 1").count()
    assert 0.73 < n / 20000 < 0.77


def test_lm(odd, none):
    got = lm_scoring.backoff_scores(odd).collect()
    assert len(got) == len(ROWS)
    at = {r["doc_id"]: r for r in got}
    assert at[1]["score"] is None and at[3]["n_words"] == 0
    assert at[4]["score"] == at[5]["score"] and at[4]["n_seen_pairs"] > 50
    assert lm_scoring.backoff_scores(none).count() == 0


def test_language(odd, none):
    model = language_id.train(odd)
    got = by_id(language_id.predict(odd, model))
    assert got[1]["lang_pred"] == got[9]["lang_pred"] == "und" and got[7]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = language_id.train(none)
    assert by_id(language_id.predict(odd, empty))[7]["lang_pred"] == "und"
    assert language_id.predict(none, model).count() == 0
    assert by_id(language_id.predict(odd, language_id.train(odd.filter("lang = 'fr'"))))[4]["lang_pred"] == "fr"


def test_codewords():
    for n in (2, 3, 4, 6, 9, 30):
        code = language_id.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n


def test_licenses(odd, none):
    got = by_id(licenses.license_scan(odd))
    assert got[8]["labels"] == "apache,cc-by,reserved" and got[8]["base_labels"] == "cc-by,reserved"
    assert got[8]["n_base"] == 2 and got[1]["n_words"] == 0 and got[1]["labels"] == "" and got[4]["score"] == 0
    assert licenses.license_scan(odd).count() == len(ROWS)
    assert licenses.license_scan(none).count() == 0


def test_packing(odd, none):
    path = packing.production_vocabulary()
    got = packing.pack_documents(odd, path).collect()
    tok = word_bpe.load_tokenizer(path)
    for doc, text, *_ in ROWS:
        n = len(tok.encode(text or "", add_special_tokens=False).ids) + 1
        copies = sum(r[0] == doc for r in ROWS)
        assert sum(r["length"] for r in got if r["doc_id"] == doc) == n * copies
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("hist", [{}, {2048: 3}, {1: 5000}, {1500: 7, 548: 7}, {700: 9, 648: 9, 1: 2000, 1024: 3}])
def test_plan_uses_the_histogram_up(hist):
    got = {}
    for config, copies in packing.plan(hist).configurations:
        assert sum(k * n for k, n in config.items()) <= 2048
        for k, n in config.items():
            got[k] = got.get(k, 0) + n * copies
    assert got == hist


def test_near_dedup(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    at = {r["doc_id"]: r for r in got}
    assert at[1]["n_shingles"] == 0 and at[1]["component_id"] == 1 and at[2]["component_id"] == 2
    assert at[5]["component_id"] == 4 and not at[5]["kept"] and at[4]["kept"]
    assert near_dedup.near_duplicates(none).count() == 0


def test_substring(odd, none):
    got = substring_dedup.substring_dedup(odd).collect()
    at = {r["doc_id"]: r for r in got}
    assert len(got) == len(ROWS) and at[1]["n_words"] == 0 and at[4]["n_removed"] == 0
    assert at[5]["kept_text"] == "" and at[6]["kept_text"] == "another beginning"
    assert at[4]["kept_text"] == ROWS[3][1] and at[4]["source"] == "s"
    assert at[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert substring_dedup.substring_dedup(none).count() == 0


def test_difference_cover():
    for p in (1, 2, 7, 13, 31):
        d = substring_dedup.difference_cover(p)
        assert {(a - b) % p for a in d for b in d} == set(range(p))
    assert len(substring_dedup.difference_cover(31)) == 6


def test_spotsigs(odd, none):
    got = spotsigs.edited_fingerprints(odd).collect()
    assert len(got) == len(ROWS)
    at = {r["doc_id"]: r for r in got}
    assert at[4]["fingerprint"] == at[5]["fingerprint"] and at[1]["fingerprint"] == "" and at[1]["near_next"] == 1.0
    assert at[4]["near_next"] == 1.0 and all(0 <= r["near_edited"] <= 1 for r in got)
    last, first = ROWS[-1][1], ""
    h = len(last) // 2
    assert at[10]["edited_sha256"] == hashlib.sha256((last[:len(last) - h] + first[:h]).encode()).hexdigest()
    assert spotsigs.edited_fingerprints(none).count() == 0
    members, pairs = spotsigs.similar_pairs(spotsigs.fingerprints(odd), 0.5)
    assert members.count() == len(ROWS) and pairs.filter("a >= b").count() == 0


def test_word_bpe(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = word_bpe.load_tokenizer(path)
    for r in word_bpe.encode(odd.select("doc_id", "text", F.lit(0).alias("ids")), path).collect():
        text = next(t for d, t, *_ in ROWS if d == r["doc_id"]) or ""
        ids = tok.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"]) == (len(ids), " ".join(map(str, ids)))
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    assert word_bpe.encode(none, path).count() == 0


def test_quality(odd, none):
    got = by_id(quality.quality_rules(odd))
    assert got[1]["n_words"] == 0 and not got[1]["kept"] and got[4]["kept"] and not got[7]["kept"]
    assert got[7]["n_repeat_words"] == got[7]["n_words"] == 24000
    assert got[8]["n_dup_lines"] == 0
    assert quality.quality_rules(none).count() == 0
