"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text come from its bytes and words in vectorised passes.  The trees are grown on a bounded sample of
labelled rows with binned features and Newton steps, all of one depth, and flattened into arrays, so that scoring walks
all trees of a batch at once.

Defined results: a null text counts as empty; empty texts get a score like others; equal texts get equal scores; without
any labelled row every score is the prior, 0.5; an empty table gives no rows; repeated rows are kept; other columns are
ignored; a single text takes about 40 times its bytes in a worker, so one of 10 MB takes 400 MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, table
from tidemark.llm.labels import held_out, sample
from tidemark.llm.shingles import mix, word_hashes
from tidemark.sources.shipping import ship

#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2 = 80, 4, 64, 0.15, 2.0
THRESHOLD = 0.3
BLOCK = 2 << 20

_KINDS = ("lower", "upper", "digit", "space", "line", "stop", "pipe", "symbol", "high")
_KIND = np.full(256, _KINDS.index("symbol"), np.uint8)
for _name, _bytes in (
    ("lower", range(ord("a"), ord("z") + 1)),
    ("upper", range(ord("A"), ord("Z") + 1)),
    ("digit", range(ord("0"), ord("9") + 1)),
    ("space", (0x20, 0x09, 0x0B, 0x0C, 0x0D)),
    ("line", (0x0A,)),
    ("stop", b".,;:'-"),
    ("pipe", b"|"),
    ("high", range(0x80, 0x100)),
):
    _KIND[list(_bytes)] = _KINDS.index(_name)

NAMES = (
    *(f"share_{kind}" for kind in _KINDS),
    *("log_bytes", "log_words", "bytes_per_word", "distinct_words", "repeated_words", "distinct_pairs", "distinct_lines", "words_per_line", "symbols_per_word", "uppers_per_word", "stops_per_word", "pipes_per_word"),
)


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[fresh], minlength=n)


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of :data:`NAMES` for each text."""
    n = len(texts)
    parts = [(text or "").encode("utf-8") for text in texts]
    sizes = np.array([len(x) for x in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * len(_KINDS) + _KIND[data], minlength=n * len(_KINDS)).reshape(n, len(_KINDS)).astype(float)
    count = dict(zip(_KINDS, kinds.T, strict=True))

    doc, word = word_hashes(texts)
    words = np.bincount(doc, minlength=n)
    next_to = doc[1:] == doc[:-1]
    repeats = np.bincount(doc[1:][next_to & (word[1:] == word[:-1])], minlength=n)
    pairs = np.bincount(doc[1:][next_to], minlength=n)
    pair = mix(word[1:] ^ (word[:-1] * np.uint64(0x9DDFEA08EB382D69)))[next_to] if len(word) else word
    lines = [line for part in parts for line in part.split(b"\n")]
    line_doc = np.repeat(np.arange(n), [part.count(b"\n") + 1 for part in parts])
    line_ids = {line: at for at, line in enumerate(dict.fromkeys(lines))}
    different = _distinct(line_doc, np.array([line_ids[line] for line in lines], np.int64), n) if n else np.zeros(0)
    line_count = np.bincount(line_doc, minlength=n)

    some, bytes_ = np.maximum(words, 1), np.maximum(sizes, 1)
    return np.column_stack(
        [
            kinds / bytes_[:, None],
            np.log1p(sizes),
            np.log1p(words),
            sizes / some,
            _distinct(doc, word, n) / some,
            repeats / some,
            _distinct(doc[1:][next_to], pair, n) / np.maximum(pairs, 1),
            different / np.maximum(line_count, 1),
            words / np.maximum(line_count, 1),
            count["symbol"] / some,
            count["upper"] / some,
            count["stop"] / some,
            count["pipe"] / some,
        ]
    ).reshape(n, len(NAMES))


@dataclass(frozen=True)
class Trees:
    """Trees of one depth, as arrays: inner nodes in level order, then leaves."""

    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if trees:
            node = np.zeros((len(x), trees), np.int64)
            tree, row = np.arange(trees), np.arange(len(x))[:, None]
            while node.size and node[0, 0] < inner:
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            total = total + self.leaf[tree, node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    inner = (1 << depth) - 1
    mean = float(y.mean()) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean))) if 0 < mean < 1 else (0.0 if not len(y) else 6.0 if mean else -6.0)
    if not 0 < mean < 1 or not len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)])
    total = np.full(n, base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = node - first
            best = np.full(count, 1e-6)
            for f in range(width):
                key = at * bins + binned[:, f]
                left_g = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(axis=1)
                left_h = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + L2) + (all_g - left_g) ** 2 / (all_h - left_h + L2) - all_g**2 / (all_h + L2)
                gain = np.where((left_h > 1.0) & (all_h - left_h > 1.0), gain, 0.0)[:, : len(cuts[f])]
                if not gain.shape[1]:
                    continue
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best
                best = np.where(better, gain[np.arange(count), top], best)
                feature[t, first : first + count] = np.where(better, f, feature[t, first : first + count])
                threshold[t, first : first + count] = np.where(better, cuts[f][top], threshold[t, first : first + count])
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + L2)
        total = total + leaf[t, at]
    return Trees(feature, threshold, leaf, base)


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Trees:
    """Trees from a sample of at most ``most`` labelled documents, whose statistics alone come to the driver."""

    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, most=BLOCK):
                x = statistics(block.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = sample(documents, labels, "quality", most).mapInArrow(run, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(NAMES))
    return fit(x, rows["label"].to_numpy(float))


def score(documents: DataFrame, model: Trees, into: str = "score") -> DataFrame:
    """``documents`` with a column ``into``: how likely a text is of good quality (a column of that name is replaced)."""
    ship(documents.sparkSession)
    documents = documents.drop(into)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, most=BLOCK):
                scores = model.score(statistics(block.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(scores, pa.float64())], [*names, into])

    return documents.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + f", `{into}` double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
