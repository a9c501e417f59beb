"""Rows with null ids, ties, and texts longer than the slices that operators cut Arrow batches into."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sievekit.llm import (language_id, licenses, lm_scoring, packing, quality, sharding, spotsigs, word_bpe)
from sievekit.llm.blocks import SLICE_BYTES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, slot string, law string, grown_shard string, piece string, start string, component_id string"
LONG = "the cat sat on the mat and the dog lay in the sun all rights reserved " * (2 * word_bpe.CHUNK_BYTES // 70 + 9)
ROWS = [(None, "the first of the rows without an id", "en"), (None, "le chat dans la maison et le chien", "fr"),
        (None, None, None), (1, "the cat and the dog in the house of the man", "en"), (2, LONG, "en"), (3, "el perro y la casa de los gatos", "es")]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG.encode()) > 2 * max(SLICE_BYTES, word_bpe.CHUNK_BYTES)
    return spark.createDataFrame([(i, t, lang, "s", k, *["x"] * 7) for k, (i, t, lang) in enumerate(ROWS)], SCHEMA).cache()


def ids(rows):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows)


WANT = sorted((i is not None, i or 0) for i, _, _ in ROWS)


def test_sharding(docs):
    got = sharding.assign(docs, "doc_id", [1.0, 1.0, 2.0]).collect()
    assert ids(got) == WANT and len({r["shard"] for r in got if r["doc_id"] is None}) == 1


def test_sharding_ties(spark):
    """A key's draws for two shards are never equal here, so a tie is made of equal scores: the smaller number wins."""
    best = F.greatest(*[F.struct(F.lit(0.5).alias("s"), F.lit(-k).alias("k")) for k in (2, 0, 1)])
    assert spark.range(1).select((-best["k"]).alias("k")).first()["k"] == 0


def test_lm(docs):
    got = lm_scoring.backoff_scores(docs).collect()
    assert ids(got) == WANT
    assert next(r for r in got if r["doc_id"] == 2)["n_words"] == len(LONG.split())


def test_language(docs):
    got = language_id.predict(docs, language_id.train(docs)).collect()
    assert ids(got) == WANT
    assert [r["lang_pred"] for r in got if r["lang"] is None] == ["und"]
    assert all(r["lang_pred"] in ("en", "es", "fr") for r in got if r["lang"])


def test_language_ties_go_to_the_first(spark):
    same = spark.createDataFrame([("aaa bbb", "zz"), ("aaa bbb", "aa")], "text string, lang string")
    model = language_id.train(same)
    assert {r["lang_pred"] for r in language_id.predict(same.select("text"), model).collect()} == {"aa"}


def test_decoder_by_hand(spark):
    """Loss-weighted decoding against a plain sum over bits, for margins of every size."""
    import numpy as np
    rng = np.random.default_rng(4)
    langs = ["de", "en", "es", "fr"]
    counts = {x: rng.integers(0, 50, language_id.BUCKETS).astype(float) for x in langs}
    model = language_id.Model(counts)
    margins = rng.normal(0, 1, (60, model.code.shape[1])) * model.scale
    best, p, lead = model.decode(margins)
    for k, m in enumerate(margins):
        loss = [sum(w * np.exp(-max(-4, min(4, v / s)) * c) for w, v, s, c in zip(model.weight, m, model.scale, row)) for row in model.code]
        first, second = sorted(loss)[:2]
        assert best[k] == loss.index(first) and lead[k] == pytest.approx(second - first)
        share = np.exp([-language_id.SHARPNESS * (x - first) for x in loss])
        assert p[k] == pytest.approx(1 / share.sum())


def test_licenses(docs):
    got = licenses.license_scan(docs).collect()
    assert ids(got) == WANT
    r = next(r for r in got if r["doc_id"] == 2)
    assert r["n_base"] == LONG.count("all rights reserved") and r["n_words"] == len(LONG.split())


def test_packing(docs):
    path = packing.production_vocabulary()
    tok = word_bpe.load_tokenizer(path)
    got = packing.pack_documents(docs, path).collect()
    want = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ROWS)
    assert sum(r["length"] for r in got) == want
    assert sum(r["length"] for r in got if r["doc_id"] is None) == sum(
        len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in ROWS if i is None)


def test_spotsigs(docs):
    """All columns of all rows: nulls first, then by text; the next of the last row is the first."""
    got = spotsigs.edited_fingerprints(docs).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    own = {t or "": spotsigs.signatures(__import__("pyarrow").array([t or ""]))[0] for _, t, _ in ROWS}
    want = []
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        sig = spotsigs.signatures(__import__("pyarrow").array([edited]))[0]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.fingerprint(own[t]), spotsigs.fingerprint(sig),
                     round(spotsigs.likeness(own[t], sig), 9), round(spotsigs.likeness(own[t], own[nxt]), 9)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9),
                    round(r["near_next"], 9)) for r in got], key=key) == sorted(want, key=key)


def test_bpe(docs):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = word_bpe.load_tokenizer(path)
    for r in word_bpe.encode(docs, path).collect():
        ids_ = tok.encode(ROWS[r["n_chars"]][1] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids_) and r["ids"] == " ".join(map(str, ids_))
    assert ids(word_bpe.encode(docs, path).collect()) == WANT


def test_quality(docs):
    got = quality.quality_rules(docs.select("doc_id", "text", "lang")).collect()
    assert ids(got) == WANT
    assert next(r for r in got if r["doc_id"] == 2)["base_failed"]
