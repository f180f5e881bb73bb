"""Searches, fingerprints, pieces, classifiers and the pipeline."""

import functools
import importlib
import os
import random
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioquery.llm.components import components
from folioquery.llm.hilbert import hilbert_keys, nearest
from folioquery.llm.maxscore import Shard, top_k
from folioquery.llm.quality import difference, fit_quality, score_quality
from folioquery.llm.simhash import GrayIndex, drop_near_duplicates, gray_rank, near, simhash_groups, tree_edges
from folioquery.llm.toxicity import fit_toxicity, score_toxicity

VECTORS = "vec_id long, embedding array<float>"


def vectors(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(n, dim)) / 4)]


ODD = [(9000, None), (9010, [1.0, None] + [0.0] * 14), (9020, [float("nan")] * 16), (9030, [float("inf")] * 16), (None, [9.0] * 16)]


def test_top_k_is_exact(spark):
    rows = vectors(900) + [(2000 + i, [0.5] * 16) for i in range(300)] + ODD + [(9040, [0.0] * 16), (50, [1.0, 2.0]), (7, [0.25] * 16), (7, [0.25] * 16)]
    got = defaultdict(list)
    for r in sorted(top_k(spark.createDataFrame(rows, VECTORS).withColumn("asks", F.lit(1)), F.col("vec_id") % 50 == 0, 5).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    usable = [(i, np.floor(256 * np.array(v + [0.0] * (16 - len(v))))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    best = defaultdict(dict)
    for q, x in usable:
        if q % 50 == 0:
            for i, y in usable:
                if i != q:
                    s = int(x @ y)
                    best[q][i] = max(best[q].get(i, s), s)
    assert dict(got) == {q: sorted(b.items(), key=lambda z: (-z[1], z[0]))[:5] for q, b in best.items()}
    assert top_k(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 12), st.integers(1, 6), st.integers(0, 10**6))
def test_shard_matches_brute_force(n, dim, k, seed):
    rng = np.random.default_rng(seed)
    v, q = rng.integers(-5, 6, (n, dim)).astype(float), rng.integers(-5, 6, dim).astype(float)
    ids = rng.permutation(n * 2)[:n]
    want = sorted(((-int(q @ x), int(i)) for i, x in zip(ids, v, strict=True) if i != ids[0]))[:k]
    got_ids, got = Shard(ids, v).best(int(ids[0]), q, k)
    assert [(-int(s), int(i)) for i, s in zip(got_ids, got, strict=True)] == want


def test_essential_terms_are_the_shortest_prefix():
    rng = np.random.default_rng(8)
    v = np.floor(256 * rng.normal(size=(3000, 64)) / 8)
    shard = Shard(np.arange(3000), v)
    for i in range(20):
        q = v[i]
        most, least = np.maximum(q * shard.high, q * shard.low), np.minimum(q * shard.high, q * shard.low)
        rest = np.concatenate([np.cumsum(most[::-1])[::-1], [0.0]])
        theta = float(np.sort(v @ q)[-5])
        m = shard.essential(least, rest, theta)
        assert 0 < m < 64 and least[:m].sum() + rest[m] < theta <= least[: m - 1].sum() + rest[m - 1]
        shard.best(i, q, 5)
    traversed, terms, _, _ = shard.work
    assert traversed < terms / 2


def test_hilbert_curve_visits_neighbours():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = hilbert_keys(cells, 3)
    assert sorted(key) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest_recall(spark):
    rows = vectors(3000, seed=3) + [(5000 + i, [0.3125] * 16) for i in range(900)] + ODD + [(9040, [0.0] * 16)]
    out = nearest(spark.createDataFrame(rows, VECTORS).withColumn("block", F.lit(1)), F.col("vec_id") % 20 == 0, 20).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    usable = {i: np.array(v) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    ids, x = np.array(sorted(usable)), np.array([usable[i] for i in sorted(usable)])
    hit = 0
    assert set(got) == {i for i in usable if i % 20 == 0}
    for q, found in got.items():
        s = x @ usable[q]
        s[ids == q] = -np.inf
        hit += len({i for i, _ in found} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        assert len(found) == 20 and found == sorted(found, key=lambda z: (-z[1], z[0]))
        assert all(abs(v - usable[i] @ usable[q]) < 1e-12 for i, v in found)
    assert hit / (20 * len(got)) >= 0.9
    few = nearest(spark.createDataFrame(rows[:3], VECTORS), F.col("vec_id") == 0).collect()
    assert len(few) == 2 and nearest(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0


def test_narrow_windows_find_clustered_vectors(spark, monkeypatch):
    from folioquery.llm import hilbert

    fitted = []
    fit = hilbert.fit_windows
    monkeypatch.setattr(hilbert, "fit_windows", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    rng = np.random.default_rng(6)
    n = 12_000
    v = rng.normal(size=(60, 24))[rng.integers(0, 60, n)] + 0.2 * rng.normal(size=(n, 24))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], VECTORS)
    found = defaultdict(set)
    for r in nearest(df, F.col("vec_id") % 60 == 0, 20).collect():
        found[r.query_id].add(r.vec_id)
    v = v.astype(np.float64)
    hit = 0
    for q, own in found.items():
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(own & set(np.lexsort((np.arange(n), -s))[:20].tolist()))
    assert len(found) == n // 60 and hit / (20 * len(found)) >= 0.9
    assert fitted[0].share(n) < 0.2


def test_nearest_takes_repeats_ties_and_unequal_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0]), (3, [1.0, 0.0]), (4, [0.5]), (4, [0.5]), (5, [0.0, 2.0, 1.0])]
    got = nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 3, 3).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, 1.0), (3, 4, 0.5)]


def fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def test_simhash_groups_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(120)]
        for c in range(1 + g % 5):
            text = list(base)
            for _ in range(c):
                text[rng.randrange(120)] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(text)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "a b"), (906, "É b c"), (907, "é b c"), (908, "very long " * 40_000)]
    more = simhash_groups(spark.createDataFrame([*rows, (5, "another text"), (None, "One"), (None, "alone")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in more if r.fingerprint == f"{fingerprint('One'):016x}" and r.doc_id) == [(903, 903), (904, 903)]
    assert {(r.doc_id, r.component_id) for r in more if r.doc_id is None} == {(None, 903), (None, None)} and len(more) == len(rows) + 3
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("code", F.lit(1))).collect()
    prints = {i: fingerprint(t) for i, t in rows}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_groups(prints)
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [16, 100, 2048])
def test_index_over_many_ranges_loses_no_link(spark, monkeypatch, block):
    from folioquery.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(1)
    codes = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 1 << 63}
    for c in list(codes)[:12]:
        for _ in range(60):
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                c ^= 1 << b
            codes.add(c)
    signed = {c: simhash.signed(c) for c in codes}
    edges = simhash.code_links(spark.createDataFrame([(c,) for c in signed.values()], "code long"), 2).collect()
    assert len(edges) < 8 * len(codes)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = lambda of: {frozenset(c for c in codes if of[c] == g) for g in set(of.values())}
    assert group({c: found.get(s, s) for c, s in signed.items()}) == group(brute_groups({c: c for c in codes}))


def test_gray_index_equals_brute_force():
    rng = np.random.default_rng(2)
    for n, m, limit in ((1, 1, 2), (1, 500, 2), (500, 300, 3), (300, 300, 0), (64, 900, 12)):
        base = rng.integers(0, 2**64, max(1, n // 8), dtype=np.uint64)
        a, b = (base[rng.integers(0, len(base), k)] for k in (n, m))
        for _ in range(4):
            b = b ^ (np.uint64(1) << rng.integers(0, 64, m).astype(np.uint64))
        got = [(int(i), int(j)) for x, y in near(GrayIndex(a), GrayIndex(b), limit) for i, j in zip(x, y, strict=True)]
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None]) <= limit), strict=True)}
        assert set(got) == want and len(got) == len(want)
    # entries that are sets of codes: a pair stays as long as the bits that both fix allow it
    codes = np.sort(rng.integers(0, 2**16, 400, dtype=np.uint64))
    low, high = np.bitwise_and.reduceat(codes, range(0, 400, 20)), np.bitwise_or.reduceat(codes, range(0, 400, 20))
    got = {(int(i), int(j)) for x, y in near(GrayIndex(codes), GrayIndex(low, high), 2) for i, j in zip(x, y, strict=True)}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.bitwise_count((codes[:, None] ^ low) & ~(low ^ high)) <= 2), strict=True)}
    n = np.arange(64, dtype=np.uint64)
    assert (gray_rank(n ^ n >> np.uint64(1)) == n).all()
    a, b = tree_edges(np.arange(100), np.zeros(100, dtype=np.int64))
    assert max(np.bincount(np.concatenate([a, b]))) <= 3 and len(a) == 99


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 400)] + [(5, 5), (None, 7), (8, None), (100, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1} | {i: 1 for i in range(200, 400)}


def test_near_copies_leave_one(spark):
    rng = random.Random(9)
    rows, groups = [], []
    for g in range(30):
        base = [f"v{rng.randrange(5000)}" for _ in range(200)]
        members = []
        for c in range(4):
            text = list(base)
            for _ in range(2 if c else 0):
                text[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
            members.append(rows[-1][0])
        groups.append(members)
    rows += [(1000 + i, " ".join(f"s{rng.randrange(5000)}" for _ in range(60))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "same row"), (2002, "same row"), (None, "no id"), (None, "no id"), (2003, "NO ID")]
    out = [r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))).collect()]
    for members in groups:
        assert [i for i in out if i in members] == members[:1]
    assert sorted(i for i in out if i is not None and 1000 <= i < 2000) == list(range(1000, 1040))
    assert sorted(i for i in out if i is not None and i >= 2000) == [2000, 2002, 2003] and None not in out


MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@functools.cache
def model():
    from folioquery.llm.pieces import PieceModel

    return PieceModel(MODEL)


@functools.cache
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab eirstn.,!▁\n\té日0"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_match_the_library(text):
    ours, theirs = model(), library()
    ids = theirs.encode(text)
    assert ours.encode(text) == ids
    assert ours.decode(ids) == theirs.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert model().decode(ids) == library().decode(ids)


@pytest.mark.parametrize("chunk", [1, 3, 16, 48])
def test_long_words_are_merged_in_chunks(monkeypatch, chunk):
    from folioquery.llm import pieces

    monkeypatch.setattr(pieces, "CHUNK", chunk)
    monkeypatch.setattr(pieces, "REMEMBERED", 3000)
    rng = random.Random(chunk)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "aab -", "-", "etaoin ", "日本語中国人的", "▁ a", "ABCxyz0189+/", "the and ing tion"]
    known, theirs = pieces.Known(), library()
    for _ in range(60):
        texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([1, 15, 47, 49, 300, 900]))) for _ in range(2)]
        texts += ["", (rng.choice(["re", "-", "aba", "anan", "--=", "  ", "日", "th"]) * 400)[: rng.randrange(400)]]
        ids, size, decoded = model().encode_texts(texts, known)
        for text, own, back in zip(texts, np.split(ids, np.cumsum(size)[:-1]), decoded, strict=True):
            assert own.tolist() == theirs.encode(text, add_eos=True) and back == theirs.decode(own.tolist())
        assert known.chars <= 3000 and all(len(w) <= pieces.LONGEST for w in known.index)


def test_documents_are_encoded_whole(spark):
    from folioquery.llm.pieces import encode_documents

    texts = [None, "", " ", "plain words here", "x" * 3000, "re" * 2000 + " end", "long text " * 20_000, "日本 ▁ \x00 😀", "a" * 255 + " " + "b" * 257, "qwertyuiopasdfgh" * 20_000, "-" * 100_001]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("piece_ids", F.lit("mine"))
    theirs = library()
    for r in encode_documents(df, MODEL).collect():
        ids = theirs.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.piece_ids == ids and r.decoded == theirs.decode(ids)
    assert encode_documents(df.limit(0), MODEL).count() == 0


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "er", "on", "the", "is", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            text = [w.upper() + "!!" for w in text]
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["vilefool", "vilefools", "vilest"])
            text[rng.randrange(len(text))] = "vilefool"
        docs.append((i, " ".join(text), "en"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_quality_is_learned(spark):
    docs, labels = corpus()
    docs += [(1000, None, None), (1001, "", "en")]
    labels += [(None, 1, 1), (5, None, 0), (6, 0, 1), (6, 1, 0), (7, 9, 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.quality_score for r in score_quality(d.withColumn("quality_score", F.lit("x")), fit_quality(d, lab)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(out[i] >= 0.5) == (i % 4 != 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in out.values()) and len(out) == len(docs)
    assert 1000 in out and out[1000] == out[1001]
    sizes = np.array([[300, 200], [250, 200], [200, 200], [200, 250], [0, 0]])
    model = fit_quality(d, lab)
    assert list(difference(sizes)) == [-1 / 3, -0.2, 0.0, 0.2, 0.0] and (np.diff(model.score(sizes)[:4]) > 0).all()
    none = fit_quality(d, lab.limit(0))
    assert {r.quality_score for r in score_quality(d, none).collect()} == {0.5}
    assert score_quality(d.limit(0), none).count() == 0


def test_toxicity_is_learned(spark):
    docs, labels = corpus()
    docs += [(1000, None, None), (1001, "", "en")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_toxicity(d, lab)
    out = {r.doc_id: r.toxic_score for r in score_toxicity(d.withColumn("toxic_score", F.lit("x")), model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in out.values()) and len(out) == len(docs)
    one = fit_toxicity(d, lab.where("toxic = 0"))
    assert {r.toxic_score for r in score_toxicity(d, one).collect()} == {0.0}
    assert score_toxicity(d.limit(0), model).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs, labels = corpus(400)
    docs = [(i, t, lang, f"src{i % 3}", len(t)) for i, t, lang in docs]
    docs += [(5000, docs[1][1], "en", "src1", 1), (5001, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "encode"]
    out = pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert 5000 not in ids and len([i for i in ids if i % 4 == 0]) <= 5
    assert all(r.n_tokens == len(r.piece_ids) and r.piece_ids[-1] == 2 for r in out)


def test_pipeline_takes_odd_rows(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs, labels = corpus(200)
    docs = [(i, t, lang, f"src{i % 3}", len(t), "mine", 7) for i, t, lang in docs]
    docs += [(5000, None, None, None, None, None, None), (5001, "", "en", "src1", 0, None, None), (None, "no id " * 30, "en", "src2", 1, None, None), (None, "no id " * 30, "en", "src2", 1, None, None)]
    docs += [docs[1], docs[1], (5002, "unbroken" * 20_000, "en", "src0", 1, None, None)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, n_lines long"
    for name, rows in (("full", docs), ("empty", [])):
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        step = stage(spark, step, f"{tmp_path}/full")
        assert step.columns == [c.split()[0] for c in shape.split(", ")]
    assert {r.quality_score for r in step.where("doc_id < 200").collect()} == {"mine"}
    out = pipeline.run(spark, f"{tmp_path}/full").collect()
    assert len(out) > 50 and all(r.n_tokens == len(r.piece_ids) for r in out)
    assert pipeline.run(spark, f"{tmp_path}/empty").count() == 0


WITHOUT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", "file://{work}/shared").getOrCreate()
)
import __spark_entry__ as entry
for name in ("op2_top_k", "op6_pieces", "op7_toxicity", "op8_simhash", "op9_quality", "op10_nearest", "pipeline"):
    print(name, entry.queries()[name](spark, {data!r}).count())
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    # Plain workers: another folder, and nothing of this repository on their path.
    repo, data = str(Path(__file__).resolve().parents[2]), "/root/testdata/sf0.001"
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    script = WITHOUT.format(repo=repo, work=tmp_path, data=data)
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    assert len(out.stdout.split("\n")) >= 7
