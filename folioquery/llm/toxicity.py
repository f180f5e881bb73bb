"""Convolutional toxicity classifier in numpy."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.labelled import fold, labelled_sample

WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
BUCKETS = 1 << 15
#: A word is embedded as the sum of its own bucket and those of these prefixes,
#: so that an inflected form shares what was learned about its stem.
PREFIXES = (3, 4, 5, 6)
_ROWS = 1 + len(PREFIXES)
_WORD = re.compile(r"[^\W_]+")
#: Words per forward step: bounds memory, except for one longer text.
STEP = 200_000
#: Words whose buckets a worker remembers.
REMEMBERED = 100_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_buckets(word: str) -> list[int]:
    """Buckets of the word and of its prefixes."""
    parts = [word, *(f"{n}{word[:n]}" for n in PREFIXES)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for p in parts]


def buckets_of(words: list[str], known: dict[str, list[int]]) -> np.ndarray:
    """Buckets of words, a row each. ``known`` remembers short ones, up to REMEMBERED; beyond, it forgets all."""
    if len(known) > REMEMBERED:
        known.clear()
    out = []
    for w in words:
        own = known.get(w)
        if own is None:
            own = word_buckets(w)
            if len(w) <= 32:
                known[w] = own
        out.append(own)
    return np.array(out, dtype=np.int64).reshape(-1, _ROWS)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class ToxicityModel:
    """Embeddings folded into the filters, the output layer, and the curve of each language.

    ``table`` has, for each bucket, what it adds to every filter at every offset
    of the filter's window.
    """

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    curves: dict[str, tuple[float, float]] = field(default_factory=dict)
    marks: dict[str, str] = field(default_factory=dict)
    prior: float | None = None
    known: dict[str, list[int]] = field(default_factory=dict)

    def score(self, texts: list[str]) -> np.ndarray:
        """Calibrated chance of label 1 for each text, over all of its words."""
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        out: list[np.ndarray] = []
        step: list[list[str]] = []
        n = 0
        for t in texts:
            words = words_of(t)
            step.append(words)
            n += len(words)
            if n >= STEP:
                out.append(self._step(step))
                step, n = [], 0
        if step:
            out.append(self._step(step))
        return np.concatenate(out) if out else np.zeros(0)

    def _step(self, docs: list[list[str]]) -> np.ndarray:
        words, ids, starts = _indexed(docs)
        z = self._raw(words, ids, starts)
        a, b = np.array([self.curves.get(lang) or self.curves[""] for lang in self._languages(words, ids, starts)]).T
        return _sigmoid(a * z + b)

    def languages(self, docs: list[list[str]]) -> list[str]:
        """The language whose marking words occur most in each text; "" without any."""
        return self._languages(*_indexed(docs))

    def raw(self, docs: list[list[str]]) -> np.ndarray:
        """Output of the network before calibration."""
        return self._raw(*_indexed(docs))

    def _languages(self, words: list[str], ids: np.ndarray, starts: np.ndarray) -> list[str]:
        names = sorted(set(self.marks.values()), reverse=True)
        if not names:
            return [""] * len(starts)
        number = {lang: i for i, lang in enumerate(names)}
        own = np.array([number.get(self.marks.get(w), -1) for w in words] + [-1])[ids]
        doc = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
        seen = np.bincount((doc * len(names) + own)[own >= 0], minlength=len(starts) * len(names)).reshape(-1, len(names))
        return [names[i] if n else "" for i, n in zip(seen.argmax(axis=1).tolist(), seen.max(axis=1).tolist(), strict=True)]

    def _raw(self, words: list[str], ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        rows = buckets_of(words, self.known)
        own = np.zeros((len(words) + 1, self.table.shape[1]), dtype=np.float32)  # the last is the padding
        for k in range(_ROWS):
            own[:-1] += self.table[rows[:, k]]
        pooled, at = [], 0
        for i, w in enumerate(WIDTHS):
            n = len(ids) - w + 1
            y = np.zeros((n, FILTERS), dtype=np.float32)
            for j in range(w):
                y += own[ids[j : j + n], at : at + FILTERS]
                at += FILTERS
            pooled.append(np.maximum.reduceat(y, starts, axis=0) + self.bias[i * FILTERS : (i + 1) * FILTERS])
        return np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.shift


def _indexed(docs: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the word numbers of all texts one after the other with padding (-1) around each, and where each text begins."""
    index: dict[str, int] = {}
    flat: list[int] = []
    starts = []
    for d in docs:
        starts.append(len(flat))
        flat += (-1, -1)
        flat += [index.setdefault(w, len(index)) for w in d]
    flat += (-1, -1)
    return list(index), np.array(flat), np.array(starts)


class _Net:
    """The network while it is trained: one document at a time, AdaGrad, gradients through the pooled windows only."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.rng, self.known = rng, {}
        self.e = np.vstack([rng.normal(0, 0.03, (BUCKETS, DIM)), np.zeros(DIM)])
        self.w = [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS]
        self.b = [np.zeros(FILTERS) for _ in WIDTHS]
        self.v = rng.normal(0, 0.3, len(WIDTHS) * FILTERS)
        self.c = np.zeros(1)
        self.sq = {k: np.full(np.shape(x), 1e-4) for k, x in self._parts()}

    def _parts(self):
        yield "e", self.e
        for i in range(len(WIDTHS)):
            yield f"w{i}", self.w[i]
            yield f"b{i}", self.b[i]
        yield "v", self.v
        yield "c", self.c

    def rows(self, words: list[str]) -> np.ndarray:
        pad = np.full((2, _ROWS), BUCKETS)
        return np.concatenate([pad, buckets_of(words, self.known), pad])

    def forward(self, rows: np.ndarray):
        x = self.e[rows].sum(axis=1)
        pooled, arg = [], []
        for w, m, b in zip(WIDTHS, self.w, self.b, strict=True):
            n = len(x) - w + 1
            y = sum(x[j : j + n] @ m[j] for j in range(w)) + b
            a = y.argmax(axis=0)
            arg.append(a)
            pooled.append(y[a, np.arange(FILTERS)])
        h = np.maximum(np.concatenate(pooled), 0)
        return x, h, arg, float(h @ self.v + self.c[0])

    def learn(self, rows: np.ndarray, y: int, weight: float, rate: float = 0.1) -> None:
        x, h, arg, z = self.forward(rows)
        g = weight * (_sigmoid(z) - y)
        gh = g * self.v * (h > 0)
        self._step("v", self.v, ..., g * h, rate)
        self._step("c", self.c, ..., np.array([g]), rate)
        for i, w in enumerate(WIDTHS):
            go = gh[i * FILTERS : (i + 1) * FILTERS]
            f = np.flatnonzero(go)
            if not len(f):
                continue
            go, a = go[f], arg[i][f]
            for j in range(w):
                ge = np.repeat(self.w[i][j][:, f].T * go[:, None], _ROWS, axis=0)
                gw = (x[a + j] * go[:, None]).T
                self._step(f"w{i}", self.w[i], (j, slice(None), f), gw.T, rate)
                at = rows[a + j].ravel()
                np.add.at(self.sq["e"], at, ge**2)
                np.add.at(self.e, at, -rate * ge / np.sqrt(self.sq["e"][at]))
            self._step(f"b{i}", self.b[i], f, go, rate)
        self.e[BUCKETS] = 0

    def _step(self, name: str, part: np.ndarray, at, g: np.ndarray, rate: float) -> None:
        self.sq[name][at] += g**2
        part[at] -= rate * g / np.sqrt(self.sq[name][at])

    def model(self) -> ToxicityModel:
        table = np.concatenate([self.e[:BUCKETS] @ m[j] for m in self.w for j in range(len(m))], axis=1)
        return ToxicityModel(table.astype(np.float32), np.concatenate(self.b).astype(np.float32), self.v.astype(np.float32), float(self.c[0]))


def _platt(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve, classes weighted to ``share`` of label 1; weak pull to (1, 0)."""
    x = np.stack([z, np.ones(len(z))], axis=1)
    w = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) if 0 < y.mean() < 1 else np.ones(len(y))
    beta, rest, pull = np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.diag([1.0, 0.1])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + pull, x.T @ (w * (p - y)) + pull @ (beta - rest))
        beta = beta - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def language_marks(docs: list[tuple[list[str], str]], per_language: int = 60) -> dict[str, str]:
    """Words that mark a language: those in the largest share of its documents over the share elsewhere."""
    of: dict[str, Counter] = {}
    n = Counter(lang for _, lang in docs)
    for words, lang in docs:
        of.setdefault(lang, Counter()).update(set(words))
    marks: dict[str, str] = {}
    for lang in sorted(of):
        gain = {w: k / n[lang] - max((o[w] / n[x] for x, o in of.items() if x != lang), default=0.0) for w, k in of[lang].items()}
        for w in sorted(gain, key=lambda w: (-gain[w], w))[:per_language]:
            if gain[w] > 0.05:
                marks.setdefault(w, lang)
    return marks


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0, per_class: int = 1000, max_words: int = 2_000_000, seed: int = 7) -> ToxicityModel:
    """Train on at most ``per_class`` documents of each class outside the held-out fold.

    The driver reads these whole texts, up to ``max_words`` words in all (texts beyond are left out
    of the sample). A fifth of the sample calibrates: a logistic curve for
    each language, found from the text by marking words, with a curve over all
    languages where a language has fewer than 20 documents or one label only.
    Without both labels, every score is the share of label 1 (0.5 without labels).
    """
    sample = labelled_sample(docs, labels, "toxic", folds=folds, held_out=held_out, per_class=per_class)
    clear = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    share = clear.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"]
    prior = 0.5 if share is None else float(share)
    rows: list[tuple[list[str], int, str]] = []
    left = max_words
    for r in sample.select("text", "label", "lang", "draw").orderBy("draw").toLocalIterator():
        words = words_of(r["text"])
        if len(words) <= left:
            left -= len(words)
            rows.append((words, r["label"], r["lang"] or ""))
    y = np.array([r[1] for r in rows])
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, prior=prior)
    net = _Net(seed)
    rank = {c: 0 for c in (0, 1)}
    learn, test = [], []
    for i, label in enumerate(y):  # every fifth of each class calibrates
        (test if rank[label] % 5 == 4 else learn).append(i)
        rank[label] += 1
    data = {i: net.rows(rows[i][0]) for i in learn}
    positive = y[learn].mean()
    weight = {1: min(3.0, 0.5 / max(positive, 1e-9)), 0: 0.5 / max(1 - positive, 1e-9)}
    for _ in range(int(np.clip(8000 // max(len(learn), 1), 5, 20))):
        for i in net.rng.permutation(learn):
            net.learn(data[i], int(y[i]), weight[int(y[i])])
    model = net.model()
    model.marks = language_marks([(r[0], r[2]) for r in rows])
    test = test if len(set(y[test])) == 2 else learn
    tested = [rows[i][0] for i in test]
    z, lang = model.raw(tested), np.array(model.languages(tested))
    share = min(max(prior, 0.01), 0.99)
    model.curves[""] = _platt(z, y[test], share)
    for k in sorted(set(lang) - {""}):
        own = lang == k
        if own.sum() >= 20 and 0 < y[test][own].mean() < 1:
            model.curves[k] = _platt(z[own], y[test][own], share)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``docs`` with ``toxic_score``, from all words of every text.

    * null and empty texts: the score of a text without words.
    * an input column named ``toxic_score`` is replaced.
    * empty table: empty result. Repeated rows are scored one by one.
    """
    names = [c for c in docs.columns if c != "toxic_score"]
    shape = docs.select(*names).withColumn("toxic_score", F.lit(0.0)).schema
    place = names.index("text")
    # One table of BUCKETS rows. Plain values travel, the model is put together in the task.
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.out, model.shift, model.curves, model.marks, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                score = model.score([t.as_py() or "" for t in batch.column(place)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score.astype(np.float64), pa.float64())], [*names, "toxic_score"])

    return docs.select(*names).mapInArrow(run, shape)
