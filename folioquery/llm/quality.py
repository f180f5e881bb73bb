"""Quality classifier from compressed sizes under two dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.labelled import fold, labelled_sample

#: Whole texts are compressed in blocks of this many bytes, so that a dictionary
#: helps all of a text and not only its beginning.
BLOCK = 512
DICTIONARY_BYTES = 400_000
LEVEL = 3
#: Blocks of a class that train its dictionary, drawn from the whole texts of the sample.
DICTIONARY_BLOCKS = 8000


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and a rising logistic curve over the normalised difference of compressed sizes."""

    good: bytes
    bad: bytes
    raw: bool
    slope: float | None = None
    offset: float = 0.0
    prior: float = 0.5

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_FULLDICT
        make = lambda d: zstandard.ZstdCompressor(
            level=LEVEL,
            dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind),
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )
        return make(self.good), make(self.bad)

    def score(self, sizes: np.ndarray) -> np.ndarray:
        if self.slope is None:
            return np.full(len(sizes), self.prior)
        return _sigmoid(self.slope * difference(sizes) + self.offset)


def blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def compressed_sizes(text: str, good, bad) -> tuple[int, int]:
    """Bytes of the text under the good dictionary and under the bad one."""
    g = b = 0
    for block in blocks(text):
        g += len(good.compress(block))
        b += len(bad.compress(block))
    return g, b


def difference(sizes: np.ndarray) -> np.ndarray:
    """How much smaller the good dictionary makes a text than the bad one, by the larger size: -1 to 1; 0 for no text."""
    g, b = sizes.astype(np.float64).T
    return (b - g) / np.maximum(np.maximum(g, b), 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope (never falling) and offset of a logistic curve by Newton steps; classes weighted to ``share`` good."""
    scale = x.std() + 1e-9
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    ridge, beta = np.diag([1e-2, 1e-6]), np.zeros(2)
    for _ in range(50):
        p = _sigmoid(z @ beta)
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ beta)
        beta -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 0.0) / scale), float(beta[1])


def _dictionary(samples: list[bytes]) -> bytes | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return None


def fit_quality(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1, per_class: int = 2000, dictionary_blocks: int = DICTIONARY_BLOCKS) -> CompressionModel:
    """Train on at most ``per_class`` documents of each class outside the held-out fold.

    Half of them give blocks for the two dictionaries: ``dictionary_blocks`` a class, drawn in order of a hash
    from whole texts, one of every document before a second of any. The whole texts of the
    other half are compressed on the executors to fit the curve; the driver sees two sizes of each.
    With too few samples to train a dictionary the blocks themselves serve as
    one. If a class has fewer than two documents, every score is the share of good labels (0.5 without labels).
    """
    sample = labelled_sample(docs, labels, "quality", folds=folds, held_out=held_out, per_class=per_class)
    half = F.pmod("draw", F.lit(2))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label, draw in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = blocks(text.as_py())
                order = np.random.default_rng(draw & (2**63 - 1)).permutation(len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(own), pa.int32()), pa.array(np.arange(len(own)), pa.int64()), pa.array([draw] * len(own), pa.int64()), pa.array([own[i] for i in order], pa.binary())],
                    ["label", "nth", "draw", "block"],
                )

    cuts = sample.where(half == 0).select("text", "label", "draw").mapInArrow(cut, "label int, nth long, draw long, block binary")
    side = {y: [bytes(r["block"]) for r in cuts.where(F.col("label") == y).orderBy("nth", "draw", "block").limit(dictionary_blocks).collect()] for y in (0, 1)}
    count = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clear = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    share = clear.agg(F.avg(F.col("quality").cast("double")).alias("p")).first()["p"]
    prior = 0.5 if share is None else float(share)
    if min(count.get(0, 0), count.get(1, 0)) < 2 or not side[0] or not side[1]:
        return CompressionModel(b"", b"", True, prior=prior)
    trained = [_dictionary(side[1]), _dictionary(side[0])]
    raw = None in trained
    if raw:
        trained = [b"".join(side[y])[:DICTIONARY_BYTES] for y in (1, 0)]
    model = CompressionModel(trained[0], trained[1], raw)
    other = sample.where(half == 1)
    fitted = _sizes(other.select(F.col("label").cast("long").alias("doc_id"), "text"), model).collect()
    y = np.array([r["doc_id"] for r in fitted], dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return CompressionModel(b"", b"", True, prior=prior)
    slope, offset = fit_curve(difference(np.array([(r["good"], r["bad"]) for r in fitted])), y, min(max(prior, 0.01), 0.99))
    return CompressionModel(trained[0], trained[1], raw, slope, offset, prior)


def _sizes(docs: DataFrame, model: CompressionModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = model.compressors()
        for batch in batches:
            sizes = [compressed_sizes(t.as_py() or "", good, bad) for t in batch.column(1)]
            g, b = (pa.array(x, pa.int64()) for x in (zip(*sizes, strict=True) if sizes else ([], [])))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), g, b], ["doc_id", "good", "bad"])

    return docs.mapInArrow(run, "doc_id long, good long, bad long")


def score_quality(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """All columns of ``docs`` with ``quality_score``, from the whole of every text.

    The score is the chance of label 1, from nothing but the normalised difference of the compressed sizes under
    both dictionaries; it never falls as the difference rises.

    * null and empty texts: the score of a text of no bytes.
    * an input column named ``quality_score`` is replaced.
    * empty table: empty result. Repeated rows are scored one by one.
    """
    # Extra columns go along in Arrow untouched.
    names = [c for c in docs.columns if c != "quality_score"]
    shape = docs.select(*names).withColumn("quality_score", F.lit(0.0)).schema
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = model.compressors() if model.slope is not None else (None, None)
        for batch in batches:
            if model.slope is not None:
                sizes = [compressed_sizes(t.as_py() or "", good, bad) for t in batch.column(place)]
            else:
                sizes = [(0, 0)] * batch.num_rows
            score = model.score(np.array(sizes, dtype=np.int64).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*names, "quality_score"])

    return docs.select(*names).mapInArrow(run, shape)
