"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on binned features with second-order (logistic) gradients, and flattened into arrays, which a batch of
documents walks level by level in numpy. Fitting takes a bounded sample of labelled rows (SAMPLE_ROWS, the lowest by a
hash of the id); scoring covers every whole text.

Defined cases: null and empty texts score from the statistics of an empty text; labels that are null or of no document
are left out; ids may be of any type; with labels of one class or none, the score is that class's rate (0.5 without labels); repeated rows score
alike; an empty table gives an empty result; further columns pass through the pipeline stage; labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.llm.common import python_tasks, table

#: Most labelled rows that a fit takes.
SAMPLE_ROWS = 20_000
#: A document is kept (predicted 1) from this score on.
KEEP_SCORE = 0.7
TREES, DEPTH, BINS, RATE, L2, MIN_HESSIAN = 60, 4, 64, 0.2, 1.0, 2.0

FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper_share", "digit_share", "space_share",
    "stop_share", "mark_share", "other_punctuation_share", "bar_share", "high_byte_share", "repeat_word_share",
    "repeat_line_share", "top_word_share", "line_words", "same_neighbour_share", "marked_word_share",
]

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r", b".?,;:", b"!#$%&*@~^=+<>", b"\"'()-/[]_`{}\\", b"|"], 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 8


def statistics(text: str) -> list[float]:
    """The features of one whole text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(_CLASS[raw], minlength=9) / max(1, len(raw))
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = text.split("\n")
    same = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    marked = sum(1 for w in tally if not w[-1].isalnum() and w[-1] not in ".,;:?") / max(1, len(tally))
    return [
        np.log1p(len(raw)), np.log1p(n), lengths.mean(), lengths.std(), *counts[[1, 2, 3, 4, 5, 6, 7, 8]],
        1 - len(tally) / max(1, n), 1 - len(set(lines)) / len(lines), max(tally.values(), default=0) / max(1, n),
        np.log1p(n / len(lines)), same / max(1, n - 1), marked,
    ]


def statistics_of(texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        out[i] = statistics(text.as_py() or "")
    return out


@dataclass
class Forest:
    """Trees as arrays (tree, node): a leaf has feature -1; children of node i are left[i] and left[i] + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; every step moves all rows of a batch one level down one tree."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, left, value in zip(self.feature, self.threshold, self.left, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                split = feature[at]
                right = x[rows, np.maximum(split, 0)] > threshold[at]
                at = np.where(split < 0, at, left[at] + right)
            total += value[at]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[list, list, list, list, np.ndarray]:
    """One tree, level by level, on the histograms of gradient and hessian by (node, feature, bin)."""
    n, f = binned.shape
    feature, threshold, left, value = [-1], [0.0], [0], [0.0]
    node, open_nodes = np.zeros(n, np.int64), [0]
    offsets = np.arange(f) * BINS
    for depth in range(DEPTH + 1):
        slot = np.full(len(feature), -1)
        slot[open_nodes] = np.arange(len(open_nodes))
        rows = np.flatnonzero(slot[node] >= 0)
        cell = (slot[node[rows]] * f * BINS)[:, None] + offsets + binned[rows]
        shape = (len(open_nodes), f, BINS)
        sums = [np.bincount(cell.ravel(), np.repeat(w[rows], f), int(np.prod(shape))).reshape(shape).cumsum(2) for w in (g, h)]
        grown = []
        for k, at in enumerate(open_nodes):
            gs, hs = sums[0][k], sums[1][k]
            g_all, h_all = gs[0, -1], hs[0, -1]
            value[at] = -RATE * g_all / (h_all + L2)
            gain = gs**2 / (hs + L2) + (g_all - gs) ** 2 / (h_all - hs + L2) - g_all**2 / (h_all + L2)
            gain[(hs < MIN_HESSIAN) | (h_all - hs < MIN_HESSIAN)] = 0
            best = int(gain.argmax())
            if depth == DEPTH or gain.flat[best] <= 1e-6:
                continue
            j, cut = divmod(best, BINS)
            feature[at], threshold[at], left[at] = j, edges[j][cut] if cut < len(edges[j]) else np.inf, len(feature)
            for _ in range(2):
                feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
            inside = rows[node[rows] == at]
            node[inside] = left[at] + (binned[inside, j] > cut)
            grown += [left[at], left[at] + 1]
        if not (open_nodes := grown):
            break
    return feature, threshold, left, value, node


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """x: rows of FEATURES; y: 0 or 1."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])] if len(y) else []
    trees = []
    if len(np.unique(y)) == 2:
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        total = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            *tree, node = _grow(binned, edges, p - y, np.maximum(p * (1 - p), 1e-6))
            total += np.asarray(tree[3])[node]
            trees.append(tree)
    width = max((len(t[0]) for t in trees), default=1)
    flat = lambda i, kind: np.array([t[i] + [t[i][0] * 0] * (width - len(t[i])) for t in trees], kind).reshape(len(trees), width)
    return Forest(flat(0, np.int64), flat(1, np.float64), flat(2, np.int64), flat(3, np.float64), base)


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def _with_statistics(batches, keep: list[str]):
    for batch in batches:
        x = statistics_of(batch.column("text"))
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), values], [*keep, "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest:
    """A forest from at most `rows` labelled documents that are not held out. Only their statistics reach the driver."""
    python_tasks(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    schema = T.StructType([picked.schema["doc_id"]]).add("quality", "integer").add("x", T.ArrayType(T.DoubleType()))
    got = picked.mapInArrow(partial(_with_statistics, keep=["doc_id", "quality"]), schema)
    # Documents that repeat an id could exceed the sample: the bound holds for the rows that are collected, too.
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(rows).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["quality"].to_numpy(float))


def _scored(batches, forest: Forest, keep: list[str], score: str):
    for batch in batches:
        scores = forest.score(statistics_of(batch.column("text")))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], [*keep, score])


def score_documents(docs: DataFrame, forest: Forest, keep: list[str], score: str = "score") -> DataFrame:
    """The columns `keep` of docs, and the score."""
    python_tasks(docs.sparkSession)
    columns = list(dict.fromkeys([*keep, "text"]))
    schema = T.StructType([docs.schema[c] for c in keep]).add(score, "double")
    return docs.select(columns).mapInArrow(partial(_scored, forest=forest, keep=keep, score=score), schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, forest, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier doesn't reject."""
    forest = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, forest, docs.columns, "_sr_score").where(F.col("_sr_score") >= KEEP_SCORE).select(docs.columns)
