"""SimHash fingerprints and a Gray-order hierarchical index over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm.cluster import materialise
from folioquery.llm.components import components

#: Nodes below a node of the index.
FANOUT = 4
#: (node, node) pairs that are held at once.
FRONTIER = 500_000
#: Codes of a range of the Gray order that one task indexes, and the most ranges there are; beyond, ranges grow.
BLOCK, BLOCKS = 2048, 4096

# bits[b] holds the eight bits of the byte b, highest first
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, repeats included; of all words if they are fewer; none without words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - width + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[a:b], 42) for a, b in zip(start, end[width - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    if not len(hashes):
        return 0
    rows = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(rows[:, k], minlength=256) @ _BITS
        for bit in ones * 2 > len(hashes):
            out = out << 1 | int(bit)
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Positions of codes (unsigned 64-bit) in Gray order."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Hierarchical index of codes in Gray order, where neighbours share most bits.

    Runs of codes form nodes and runs of nodes form upper nodes. A node holds the bits
    that all codes below it have in common: a mask and their values. The entries
    can themselves be sets of codes, given by the bits set in all (``low``) and in any (``high``) of them.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray | None = None):
        self.order = np.argsort(gray_rank(low), kind="stable")
        low = low[self.order]
        high = low if high is None else high[self.order]
        self.levels = [(~(low ^ high), low)]
        while len(low) > FANOUT:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            self.levels.append((~(low ^ high), low))

    def _below(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes, and which node of the list each belongs to."""
        child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        inside = child < len(self.levels[level - 1][0])
        return child[inside], np.repeat(np.arange(len(node)), FANOUT)[inside]


def near(a: GrayIndex, b: GrayIndex, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of entries of ``a`` and of ``b`` that differ in at most ``limit`` of the bits that both fix.

    Both trees are descended together. A pair of nodes carries the differences found so far; its
    children add those in the bits that they fix and it didn't, and a pair over the limit is
    dropped with everything below both.
    """
    top = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.ravel() for x in np.indices((len(a.levels[-1][0]), len(b.levels[-1][0]))))
    stack = [(*top, i, j, np.zeros(len(i), dtype=np.uint8), np.zeros(len(i), dtype=np.uint64))]
    while stack:
        u, v, i, j, sofar, seen = stack.pop()
        if len(i) > FRONTIER:
            for cut in np.array_split(np.arange(len(i)), -(-len(i) // FRONTIER)):
                stack.append((u, v, i[cut], j[cut], sofar[cut], seen[cut]))
            continue
        (mask_a, value_a), (mask_b, value_b) = a.levels[u], b.levels[v]
        fresh = mask_a[i] & mask_b[j] & ~seen
        sofar = sofar + np.bitwise_count((value_a[i] ^ value_b[j]) & fresh)
        live = np.flatnonzero(sofar <= limit)
        if not len(live):
            continue
        i, j, sofar, seen = i[live], j[live], sofar[live], (seen | fresh)[live]
        if u == v == 0:
            yield a.order[i], b.order[j]
            continue
        down_a, down_b = u >= v, v >= u  # the higher tree first, then both
        if down_a:
            i, own = a._below(u, i)
            j, sofar, seen = j[own], sofar[own], seen[own]
        if down_b:
            j, own = b._below(v, j)
            i, sofar, seen = i[own], sofar[own], seen[own]
        stack.append((u - down_a, v - down_b, i, j, sofar, seen))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position linked to each of ``n`` positions by the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j = i[open_], j[open_]
            a, b = a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:  # every label points at a root
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def tree_edges(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a binary tree over each set of equal labels: no node has more than three."""
    order = np.argsort(label, kind="stable")
    lab = label[order]
    first = np.r_[True, lab[1:] != lab[:-1]] if len(lab) else np.zeros(0, dtype=bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(lab)), 0)) if len(lab) else np.zeros(0, dtype=np.int64)
    nth = np.arange(len(lab)) - start
    child = np.flatnonzero(nth > 0)
    parent = start[child] + (nth[child] - 1) // 2
    return ids[order[child]], ids[order[parent]]


def _rank(code: Column) -> Column:
    """Gray rank as a signed number in the same order."""
    rank = code
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def code_links(codes: DataFrame, limit: int) -> DataFrame:
    """Edges (``a``, ``b``) that connect all codes within ``limit`` bits of each other, directly or by steps.

    ``codes`` has distinct signed 64-bit ``code``s, in a written table. One Gray-order index holds them all: the order is cut into
    at most BLOCKS ranges, whose shared bits (one row each) are the upper nodes that every
    task knows; each range's own nodes are built by the task that gets it. A code is sent to the ranges that
    its differences from their shared bits don't rule out; of two ranges one asks the other.
    A task holds the codes of one range; those that ask stream past, so memory depends on neither their number nor on links.
    """
    n = codes.count()
    n_blocks = max(1, min(BLOCKS, -(-n // BLOCK)))
    cuts = [k / n_blocks for k in range(1, n_blocks)]
    bounds = np.zeros(0, dtype=np.uint64)
    if cuts:
        got = codes.agg(F.percentile_approx(_rank(F.col("code")), cuts, 20 * n_blocks)).first()[0]
        bounds = np.unique(np.array(got, dtype=np.int64)).view(np.uint64) ^ np.uint64(1 << 63)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.searchsorted(bounds, gray_rank(batch.column(0).to_numpy().view(np.uint64)), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0)], ["block", "code"])

    blocked = codes.select("code").mapInArrow(block, "block int, code long")
    nodes = blocked.groupBy("block").agg(F.bit_and("code").alias("low"), F.bit_or("code").alias("high")).orderBy("block").collect()
    number, low, high = (np.array([r[c] for r in nodes], dtype=np.int64) for c in ("block", "low", "high"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = GrayIndex(low.view(np.uint64), high.view(np.uint64))
        for batch in batches:
            own, code = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(own):
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(own), dtype=bool)), batch.column(1)], ["block", "asks", "code"])
            for i, j in near(GrayIndex(code.view(np.uint64)), upper, limit):
                to, at = number[j], own[i]
                asks = np.where((to + at) % 2 == 0, to < at, to > at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[asks].astype(np.int32)), pa.array(np.ones(int(asks.sum()), dtype=bool)), pa.array(code[i[asks]])], ["block", "asks", "code"]
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index, label = None, [], None, None

        def built() -> tuple[GrayIndex, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """The range's index, the tree of its own links, and its codes."""
            codes = np.concatenate(held)
            index = GrayIndex(codes.view(np.uint64))
            label = forest(len(codes), ((i[i < j], j[i < j]) for i, j in near(index, index, limit)))
            return index, label, codes, *tree_edges(codes, label)

        def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            own, asks, code = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            new = np.flatnonzero((own[1:] != own[:-1]) | (asks[1:] != asks[:-1])) + 1
            for at, to in zip([0, *new], [*new, len(own)], strict=True):
                if at == to:
                    continue
                if own[at] != now:
                    if held and index is None:
                        yield edges(*built()[3:])
                    now, held, index = own[at], [], None
                if not asks[at]:
                    held.append(code[at:to])
                    continue
                if index is None:
                    index, label, codes, *tree = built()
                    yield edges(*tree)
                query = code[at:to]
                for i, j in near(GrayIndex(query.view(np.uint64)), index, limit):
                    # one edge to each set of the range that is linked in itself
                    _, first = np.unique(i * len(codes) + label[j], return_index=True)
                    yield edges(query[i[first]], codes[label[j[first]]])
        if held and index is None:
            yield edges(*built()[3:])

    # Sorted to the last column, so that a task that runs again finds the same trees.
    dealt = blocked.mapInArrow(deal, "block int, asks boolean, code long")
    return dealt.repartition("block").sortWithinPartitions("block", "asks", "code").mapInArrow(search, "a long, b long")


def drop_near_duplicates(docs: DataFrame, *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Keep one document, the one with the smallest id, of each group of near copies.

    Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.
    The Gray-order index over fingerprints of five-word shingles links most of them and prefix filtering finds every other
    such pair (see ``jaccard.near_sets``); every link is verified on the whole sets. Groups are the components of the links, so two texts of a group may be less similar than that to each other.

    Returns the rows of ``docs`` that stay, all columns.

    * null and empty texts: equal, so one of them stays.
    * null ids: such a row stays only if its group has no id.
    * repeated rows: one of them. Rows that share an id but not the text: decided by their texts.
    * empty table: empty result.
    """
    from folioquery.llm.jaccard import near_sets

    narrow, links = near_sets(docs, width, similarity)
    found = components(links)
    grouped = materialise(
        narrow.join(found, "node", "left").select("doc_id", "sum", F.coalesce("component", "node").alias("component")), "near-groups"
    )
    best = materialise(
        grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sum")).alias("best")), "near-best"
    )
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("sum") == F.col("best.sum"))
    judged = materialise(grouped.join(best, "component").select("doc_id", "sum", same.alias("stays")), "near-judged")
    gone = materialise(judged.where(~F.col("stays")).select(F.col("doc_id").alias("__fq_id"), F.col("sum").alias("__fq_sum")).distinct(), "near-gone")
    text_sum = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__fq_id"]) & (text_sum == gone["__fq_sum"]), "left_anti")
    # Only rows that repeat both id and text can be left twice.
    twice = judged.where("stays").groupBy("doc_id", "sum").count().where("count > 1")
    if twice.isEmpty():
        return kept
    return kept.withColumn("__fq_sum", text_sum).dropDuplicates(["doc_id", "__fq_sum"]).drop("__fq_sum")


def fingerprints(docs: DataFrame, *, width: int = 3) -> DataFrame:
    """``doc_id`` and the signed 64-bit ``code`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [signed(majority(shingle_hashes(words_of(t.as_py() or ""), width))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(codes, pa.int64())], ["doc_id", "code"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, code long")


def simhash_groups(docs: DataFrame, *, width: int = 3) -> DataFrame:
    """Group documents whose fingerprints differ in at most 2 bits, directly or by steps.

    Equal fingerprints are one code. One Gray-order index over all codes finds the links
    (see ``code_links``), and components are formed from spanning trees.

    Returns ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest ``doc_id`` reachable.

    * null and empty texts: fingerprint zero, linked like any other.
    * null doc_id: the row is returned, but names no component; null where its component has no id at all.
    * rows that repeat an id: one row each; they don't link their different texts.
    * empty table: empty result. Other columns are not read.
    """
    prints = materialise(fingerprints(docs, width=width), "fingerprints")
    codes = materialise(prints.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    found = components(code_links(codes, 2))
    owned = codes.join(found, codes["code"] == found["node"], "left").select("code", "first", F.coalesce("component", "code").alias("component"))
    owned = materialise(owned, "code-components")
    least = materialise(owned.groupBy("component").agg(F.min("first").alias("component_id")), "component-ids")
    final = owned.join(least, "component").select(F.col("code"), "component_id")
    return prints.join(materialise(final, "code-groups"), "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
