"""Operators against brute force, on sf0.001 and on groups of near copies."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievekit.llm import near_dedup, packing, queries, spotsigs, word_bpe

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_held_out_language(spark):
    rows = queries.QUERIES["op3_ecoc_language"](spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_pieces_match_the_library(spark):
    tok = word_bpe.load_tokenizer(packing.production_vocabulary())
    rows = queries.QUERIES["op5_config_lp_packing"](spark, SF).collect()
    for d, t in texts(spark).items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for r in (r for r in rows if r["doc_id"] == d):
            part = np.array(ids[r["start"]:r["start"] + r["length"]], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * total / 2048 + 1


def test_word_bpe_matches_the_library(spark):
    tok = word_bpe.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    all_texts = texts(spark)
    for r in queries.QUERIES["op8_word_bpe"](spark, SF).collect():
        ids = tok.encode(all_texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_spotsigs_by_hand(spark):
    common = set(spotsigs.ANCHORS)

    def sig(text):
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x.decode()) for x in text.encode().split()]
        out = set()
        for i, a in enumerate(w):
            chain = [x for x in w[i + 1:] if x not in common][:2] if a in common else []
            if len(chain) == 2:
                out.add((a, *chain))
        return out or ({tuple(w)} if w else set())
    ds = sorted(texts(spark).items())
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_spotsigs"](spark, SF).collect()}
    for i, (d, x) in list(enumerate(ds))[::5]:
        y = ds[(i + 1) % len(ds)][1]
        h = len(x) // 2
        a, b = sig(x), sig(x[:len(x) - h] + y[:h])
        assert got[d]["n_chars"] == len(x) and len(got[d]["fingerprint"]) == 8 * len(a)
        assert got[d]["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_similar_pairs_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = spotsigs.fingerprints(docs).cache()
    members, pairs = spotsigs.similar_pairs(found, 0.4)
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    sets = {r["doc_id"]: set(r["signatures"]) for r in found.collect() if rep[r["doc_id"]] == r["doc_id"]}
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b]) - 1e-9}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want


@pytest.mark.parametrize("tile", [16, 512])
def test_a_large_group_of_near_copies(spark, tile):
    """Edits spread the group over the threshold, so links need more than one centre."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[3][1]) for i in range(30)]
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, tile=tile).collect()}
    assert got == {d: root(d) for d in sets}


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[1000:]
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    est = near_dedup.estimate(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(est - 1 / 3) < 0.2
    assert (near_dedup.merge(ra, rb) == near_dedup.registers(np.unique(np.concatenate([a, b])))).all()


def test_pipeline_by_hand(spark):
    """The decisions of the filtering stages, and what reaches the packed sequences."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    state, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        state = corpus_pipeline.cut_lineage(stage(spark, state, SF))
        assert state.columns == corpus_pipeline.COLUMNS
        seen.append({r["doc_id"]: r["text"] for r in state.select("doc_id", "text").collect()})
    kept = {r["doc_id"] for r in queries.QUERIES["op10_js_quality"](spark, SF).filter("kept").collect()}
    assert set(seen[0]) == kept and set(seen[1]) <= kept and len(seen[1]) >= 0.98 * len(kept)
    sets = {d: shingles(t) for d, t in seen[2].items()}
    ids = sorted(sets)
    assert not [1 for i, a in enumerate(ids) for b in ids[i + 1:]
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert set(seen[3]) == set(seen[2])
    windows = set()
    for d in ids:
        w = seen[2][d].split()
        mine = {tuple(w[i:i + 50]) for i in range(len(w) - 49)}
        assert (seen[3][d] == seen[2][d]) == (not mine & windows)
        windows |= mine
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(seen[3])


def test_pipeline_takes_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double"
    for rows in ([], [(1, None, None, None, None, True, 0.5), (2, "", "en", "s", 0, None, None)]):
        state = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            state = corpus_pipeline.cut_lineage(stage(spark, state, SF))
        assert state.count() == 0


def test_pipeline_keeps_one_of_repeated_rows(spark):
    text = "The house of the old man is on the hill and by the river it was quiet for all of us in that year."
    df = spark.createDataFrame([(4, text, "en", "s", 9)] * 3 + [(5, text, "en", "s", 9)], corpus_pipeline_schema())
    assert corpus_pipeline.near_dedup_stage(spark, df, SF).count() == 1


def corpus_pipeline_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_queries_cover_the_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    talks = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    for name, fn in queries.QUERIES.items():
        if name != "op5_config_lp_packing":         # a row per piece; op11: one per conversation
            assert fn(spark, SF).agg(F.count(F.lit(1))).first()[0] == (talks if name.startswith("op11_") else n), name
