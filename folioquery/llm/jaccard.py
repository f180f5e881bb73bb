"""Near copies by SimHash, made exact for shingle sets by prefix filtering and a count of what two sets share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.cluster import discard, materialise
from folioquery.llm.components import components
from folioquery.llm.simhash import code_links, majority, shingle_hashes, signed, words_of

#: Texts whose shingles are counted to put rare ones first; shingles in COMMON of them count as common, COMMON_KEPT at most.
#: These only decide how long buckets get: any order of shingles finds the same pairs.
SAMPLE, COMMON, COMMON_KEPT = 20_000, 4, 200_000
#: Rows of one step; members of a bucket that all others are compared with in the first round.
REPS = 3
#: Shingles that two sets must share among their first ones; fewer for sets at the similarity that can't share so many.
SHARED = 4
#: Differing bits of fingerprints within which the index links sets.
BITS = 2
_EPS = 1e-9


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, as signed numbers in order."""
    return np.unique(shingle_hashes(words_of(text), width).view(np.int64))


def prefix_length(n: int, similarity: float) -> int:
    """How many first elements of a set of ``n`` share SHARED with those of every set at the given similarity, or all that can be asked for."""
    least = math.ceil(similarity * n - _EPS)
    return n - least + min(SHARED, least)


def near_sets(docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Every text's set of shingles as a node, and all links that matter between nodes.

    The first table has ``doc_id``, ``sum`` (of the text) and ``node`` (hash of the set; equal sets are one node)
    of every row; the second has edges (``a``, ``b``) whose sets have a Jaccard similarity of at
    least ``similarity``, enough of them to connect every pair at that similarity, directly or by steps.

    The Gray-order index over the sets' fingerprints comes first and links most copies. A fingerprint differs in about 10 of its 64 bits
    at similarity 0.8, within which an index can prune nothing, so two exact rounds add what lies beyond its limit. For them
    sets are put in one order, rare shingles first. Two sets at the similarity share SHARED of
    their first ``prefix_length`` shingles (a small set fewer), so every such pair meets in that many buckets. One round
    compares the members of a bucket with the few whose fingerprints lie closest to the bucket's majority, which connects
    dense groups at linear cost; the last compares all pairs of a bucket that aren't connected yet, none is left out. Every link of
    all three is verified on the whole sets.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("sum"), F.xxhash64("doc_id", text).alias("row"), text.alias("text"))
    prints = materialise(_prefixes(keyed, *_common(keyed, width), width, similarity), "near-prints")
    # Equal sets are one row from here on, so a group of copies weighs no more than one text.
    nodes = materialise(prints.groupBy("node").agg(F.min("row").alias("row"), *[F.any_value(c).alias(c) for c in ("code", "n", "head")]), "near-nodes")
    narrow = materialise(prints.select("doc_id", "sum", "node"), "near-rows")
    discard(prints)
    owner = materialise(nodes.select("node", "row", "n", "code"), "near-owners")
    # Only what is needed to meet travels for every shingle; sizes and fingerprints join those that are shared.
    met = materialise(_shared(nodes), "near-met")
    discard(nodes)
    shared = materialise(met.join(owner.drop("row"), "node").select("token", "node", "n", "pos", "code"), "near-shared")
    discard(met)

    def links(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "near-pairs")
        # Written first: Spark then knows how few texts are wanted, and moves the others only where they are many.
        ends = materialise(owner.select("node", "row").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "near-ends")
        texts = keyed.select("row", "text").join(ends, "row").dropDuplicates(["row"]).select("node", "text")
        sets = materialise(_sets(texts, width), "near-sets")
        edges = materialise(_verified(pairs, sets, similarity), "near-edges")
        for done in (pairs, ends, sets):
            discard(done)
        return edges

    def labelled(edges: DataFrame) -> DataFrame:
        """Rows of the buckets with the component that their node is in so far."""
        return shared.join(components(edges), "node", "left").select(*shared.columns, F.coalesce("component", "node").alias("component"))

    found = links(_by_fingerprint(owner))
    found = found.unionByName(links(_candidates(labelled(found), similarity, REPS)))
    found = found.unionByName(links(_candidates(labelled(found), similarity, None)))
    for done in (shared, owner):
        discard(done)
    return narrow, found


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that the index links: nodes of one fingerprint, and the first nodes of linked fingerprints."""
    first = materialise(nodes.groupBy("code").agg(F.min("node").alias("first")), "near-codes")
    same = nodes.select("node", "code").join(first, "code").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    edges = code_links(first, BITS).select(F.col("a").alias("x"), F.col("b").alias("y"))
    near = edges.join(first.select(F.col("code").alias("x"), F.col("first").alias("a")), "x").join(first.select(F.col("code").alias("y"), F.col("first").alias("b")), "y")
    pairs = same.unionByName(near.select("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _common(keyed: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts of a bounded sample, in order, and their counts."""
    step = max(1, -(-keyed.count() // SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64))], ["token"])

    sample = keyed.where(F.pmod("sum", F.lit(step)) == 0).dropDuplicates(["sum"]).select("text")
    counted = sample.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    got = counted.orderBy(F.desc("n"), "token").limit(COMMON_KEPT).toArrow()
    token, n = (got.column(c).to_numpy().astype(np.int64) for c in ("token", "n"))
    order = np.argsort(token)
    return token[order], n[order]


def _prefixes(keyed: DataFrame, common: np.ndarray, count: np.ndarray, width: int, similarity: float) -> DataFrame:
    """``node``, fingerprint ``code``, size ``n`` and the first shingles of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, codes, sizes, heads = [], [], [], [np.zeros(0, dtype=np.int64)]
            for t in batch.column(3):
                own = shingle_set(t.as_py(), width)
                nodes.append(signed(xxhash.xxh64_intdigest(own.tobytes(), 42)))
                codes.append(signed(majority(own.view(np.uint64))))
                sizes.append(len(own))
                if len(common):
                    at = np.searchsorted(common, own).clip(max=len(common) - 1)
                    own = own[np.lexsort((own, np.where(common[at] == own, count[at], 0)))]
                heads.append(own[: prefix_length(len(own), similarity)])
            ends = np.cumsum([len(h) for h in heads])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(heads), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.int64()), pa.array(codes, pa.int64()), pa.array(sizes, pa.int32()), listed], ["doc_id", "sum", "row", "node", "code", "n", "head"])

    return keyed.mapInArrow(run, "doc_id long, sum long, row long, node long, code long, n int, head array<long>")


def _shared(nodes: DataFrame) -> DataFrame:
    """``token``, ``node`` and ``pos`` of the first shingles that two nodes or more have among theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole(batches):
            token, node = cols[:2]
            once = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
            cols = [c[once] for c in cols]
            same = cols[0][1:] == cols[0][:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], ["token", "node", "pos"])

    rows = nodes.select("node", F.posexplode("head").alias("pos", "token")).select("token", "node", "pos")
    return rows.repartition("token").sortWithinPartitions("token", "node").mapInArrow(run, "token long, node long, pos int")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), width) for t in batch.column(1)], pa.list_(pa.int64()))], ["node", "tokens"])

    return texts.mapInArrow(run, "node long, tokens array<long>")


def _candidates(rows: DataFrame, similarity: float, reps: int | None) -> DataFrame:
    """Pairs in different components that meet in enough buckets, and whose sizes and positions allow the similarity.

    With ``reps`` only pairs with one of the bucket's ``reps`` most central nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole(batches):
            for a, b, least in _bucket_pairs(*cols, similarity, reps):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(least)], ["a", "b", "least"])

    dealt = rows.select("token", "node", "n", "pos", "code", "component").repartition("token").sortWithinPartitions("token", "node")
    return dealt.mapInArrow(run, "a long, b long, least long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least")).where("n >= least").select("a", "b")


def _bucket_pairs(token, node, n, pos, code, component, similarity: float, reps: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    size = np.diff(np.r_[start, len(token)])
    mixed = np.maximum.reduceat(component, start) != np.minimum.reduceat(component, start)
    n, left = n.astype(np.int64), n.astype(np.int64) - 1 - pos

    def fit(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = component[i] != component[j]
        i, j = i[ok], j[ok]
        total = n[i] + n[j]
        ok = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - _EPS
        # At the first SHARED shingles that two sets share, no more than what is left of both can follow.
        ok &= SHARED + np.minimum(left[i], left[j]) >= similarity / (1 + similarity) * total - _EPS
        i, j = i[ok], j[ok]
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        return a, b, np.minimum(SHARED, np.ceil(similarity * np.minimum(n[i], n[j]) - _EPS).astype(np.int64))

    if reps is not None:
        order = np.lexsort((node, _off_centre(code, start, size), np.repeat(start, size)))
        at = np.arange(len(token)) - np.repeat(start, size)
        for k in range(reps):
            j = np.flatnonzero(at > k)
            yield fit(order[j - at[j] + k], order[j])
        return
    small = np.repeat(mixed & (size <= 64), size)
    for step in range(1, min(64, int(size.max()))):
        i = np.flatnonzero(small[:-step] & (token[step:] == token[:-step]))
        if not len(i):
            break
        yield fit(i, i + step)
    for s, m in zip(start[mixed & (size > 64)].tolist(), size[mixed & (size > 64)].tolist(), strict=True):
        rows = max(1, 1_000_000 // m)
        for at in range(s, s + m, rows):
            i, j = np.meshgrid(np.arange(at, min(at + rows, s + m)), np.arange(at, s + m), indexing="ij")
            ahead = i < j
            yield fit(i[ahead], j[ahead])


def _off_centre(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Differing bits between each fingerprint and the majority of its bucket."""
    bits = np.unpackbits(code.view(np.uint8).reshape(-1, 8), axis=1)
    centre = np.add.reduceat(bits, start, axis=0, dtype=np.int64) * 2 > size[:, None]
    return (bits != np.repeat(centre, size, axis=0)).sum(axis=1)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole tokens, as many as a batch ends. Rows come sorted by token, the first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        # What is held ends in the token that this batch starts with, or before it.
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut or (held and held[-1][0][-1] != cols[0][0]):
            done = held + [[c[:cut] for c in cols]]
            yield [np.concatenate(c) for c in zip(*done, strict=True)]
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole sets have the similarity."""
    at_a = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    at_b = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(at_a, "a").join(at_b, "b").where(both / (F.size("ta") + F.size("tb") - both) >= F.lit(similarity)).select("a", "b")
