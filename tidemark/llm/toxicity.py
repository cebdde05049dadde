"""Toxicity: a counterfactually regularised linear classifier on words and their beginnings.

A text is the set of its words and of their first 4 to 7 bytes, hashed.  The features that tell the labels apart best are
counted over a bounded sample of labelled rows on the executors, and a logistic model is fitted on them.  For each
labelled text that mentions a group, the identity terms are swapped for others of their kind; each other labelled text is
set beside itself with a mention put in, and that beside itself with another group's.  The fit penalises any change of the
score between the texts of a pair, so a neutral mention of a group adds nothing to a score, whether the corpus holds
mentions or not, and beginnings of words that terms share with other words weigh less.

Defined results: a null text counts as empty; empty texts get the score of a text without features; equal texts get equal
scores; without any labelled row every score is 0.5; an empty table gives no rows; repeated rows are kept; other columns
are ignored; a single text takes about 40 times its bytes in a worker, so one of 10 MB takes 400 MB.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, table
from tidemark.llm.labels import held_out, sample
from tidemark.llm.shingles import mix
from tidemark.sources.shipping import ship

#: Labelled rows that are learned from, at most; hash buckets; features that are kept.
SAMPLE, BUCKETS, FEATURES = 20_000, 1 << 20, 2000
PREFIXES = (4, 5, 6, 7)
L2, SWAP_PENALTY, STEPS = 2e-4, 2.0, 400
#: Swaps of a text that mentions a group.
SWAPS = 2
THRESHOLD = 0.5
BLOCK = 1 << 20

#: Terms of one kind are swapped for each other, in turn.
IDENTITIES = (
    ("women", "men"),
    ("woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
    # German
    ("frauen", "männer"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("homosexuelle", "heterosexuelle", "lesben"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    # French
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "hétérosexuels", "lesbiennes"),
    ("immigrés", "réfugiés", "étrangers"),
    # Spanish
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("homosexuales", "heterosexuales", "lesbianas"),
    ("inmigrantes", "refugiados", "extranjeros"),
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, distinct, by text."""
    data = np.frombuffer("\n".join([*(text or "" for text in texts), ""]).lower().encode("utf-8"), np.uint8)
    ends_of = np.cumsum([len((text or "").lower().encode("utf-8")) + 1 for text in texts])
    letter = _LETTER[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    powers = np.full(len(data) + 1, _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    undo = np.full(len(data) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    undo[0] = 1
    np.multiply.accumulate(undo, out=undo)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers[:-1], dtype=np.uint64, out=sums[1:])
    doc = np.searchsorted(ends_of, starts, side="right")
    found_doc, found = [], []
    for length in (0, *PREFIXES):
        own = np.flatnonzero(ends - starts > length)
        stop = ends[own] if not length else starts[own] + length
        value = (sums[stop] - sums[starts[own]]) * undo[starts[own]]
        found.append((mix(value + _U(length)) % _U(BUCKETS)).astype(np.int64))
        found_doc.append(doc[own])
    pairs = np.unique(np.concatenate(found_doc).astype(np.int64) * BUCKETS + np.concatenate(found))
    return pairs // BUCKETS, pairs % BUCKETS


class Swapper:
    """Counterfactuals of a text: identity terms swapped for others of their kind, or put in where there are none."""

    def __init__(self, identities: tuple[tuple[str, ...], ...]):
        self.kinds = [kind for kind in identities if len(kind) > 1]
        self.place = {term: (kind, at) for kind in self.kinds for at, term in enumerate(kind)}
        self.pattern = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(map(re.escape, self.place), key=len, reverse=True)) + r")(?![^\W\d_])") if self.place else None

    def swap(self, text: str, by: int = 1) -> str | None:
        """``text`` (lower-cased) with each term, a whole word, replaced by the one ``by`` places on; None without any term."""
        if self.pattern is None:
            return None

        def other(match: re.Match) -> str:
            kind, at = self.place[match[0]]
            return kind[(at + by) % len(kind)]

        out, n = self.pattern.subn(other, text.lower())
        return out if n else None

    def insert(self, text: str) -> tuple[str, str] | None:
        """``text`` with a term of a kind put in before one of its words, and with another one of the kind there; kind,
        terms and word are drawn by a hash of the text."""
        if not self.kinds:
            return None
        draw = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        draw, kind = divmod(draw, len(self.kinds))
        kind = self.kinds[kind]
        draw, one = divmod(draw, len(kind))
        draw, step = divmod(draw, len(kind) - 1)
        gaps = [0, *(match.end() for match in re.finditer(r"\s+", text))]
        at = gaps[draw % len(gaps)]
        return tuple(f"{text[:at]}{term} {text[at:]}" for term in (kind[one], kind[(one + 1 + step) % len(kind)]))

    def twins(self, text: str) -> list[tuple[str, str]]:
        """Pairs of texts whose scores are to be equal: of a text that mentions a group, the text and its SWAPS swaps; of
        any other, the text and the text with a term, and that text with another one."""
        swapped = [other for by in range(1, SWAPS + 1) if (other := self.swap(text, by)) is not None and other != text.lower()]
        if swapped:
            return [(text, other) for other in dict.fromkeys(swapped)]
        pair = self.insert(text)
        return [(text, pair[0]), pair] if pair else []


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # ascending
    weights: np.ndarray
    bias: float
    #: Pairs of a labelled text and a counterfactual that the fit held together.
    twins: int = 0

    def score(self, texts: list[str | None]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.buckets):
            doc, bucket = features(texts)
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            hit = self.buckets[at] == bucket
            total += np.bincount(doc[hit], self.weights[at[hit]], len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def fit(x: list[np.ndarray], twins: list[np.ndarray], y: np.ndarray, buckets: np.ndarray, penalty: float = SWAP_PENALTY) -> Model:
    """Logistic regression on sets of places in ``buckets``.

    ``twins``: for each pair of counterfactuals, place + 1 of what the one alone has, and the negative of it for the other.
    """
    n, width = len(y), len(buckets)
    if not n:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    rows = np.repeat(np.arange(n), [len(v) for v in x])
    cols = np.concatenate(x).astype(np.int64)
    d_rows = np.repeat(np.arange(len(twins)), [len(v) for v in twins])
    signed = np.concatenate([*twins, np.zeros(0, np.int64)]).astype(np.int64)
    d_cols, d_sign = np.abs(signed) - 1, np.sign(signed).astype(float)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, bias = np.zeros(width), float(np.log(mean / (1 - mean)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p = 1.0 / (1.0 + np.exp(-np.clip(bias + np.bincount(rows, w[cols], n), -30, 30)))
        error = (p - y) / n
        grad = np.bincount(cols, error[rows], width) + L2 * w
        if len(twins):
            change = np.bincount(d_rows, w[d_cols] * d_sign, len(twins))
            grad += 2 * penalty / len(twins) * np.bincount(d_cols, change[d_rows] * d_sign, width)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        rate = 0.1 / (1 + 2 * step / STEPS)
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-6)
    return Model(buckets, w, bias, len(twins))


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE, identities: tuple[tuple[str, ...], ...] = IDENTITIES, penalty: float = SWAP_PENALTY) -> Model:
    """A model from a sample of at most ``most`` labelled documents; only counts, kept features and what tells twins apart
    come to the driver."""
    ship(documents.sparkSession)
    rows = sample(documents, labels, "toxic", most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, most=BLOCK):
                doc, bucket = features(block.column("text").to_pylist())
                label = block.column("label").to_numpy()[doc]
                kinds, at = np.unique(bucket, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.bincount(at, minlength=len(kinds)).astype(np.int64)), pa.array(np.bincount(at, label, len(kinds)).astype(np.int64))], ["bucket", "n", "toxic"])

    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = rows.mapInArrow(count, "bucket long, n long, toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    share = toxic / total if total else 0.0
    expected = F.col("n") * F.lit(share)
    best = counts.filter("n >= 5").withColumn("lift", (F.col("toxic") - expected) ** 2 / (expected + 1.0)).orderBy(F.desc("lift"), "bucket").limit(FEATURES).collect()
    own = features([term for kind in identities for term in kind])[1] if identities else np.zeros(0, np.int64)
    buckets = np.unique(np.concatenate([np.array([row["bucket"] for row in best], np.int64), own]))
    swapper = Swapper(identities)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(texts: list[str]) -> list[list[int]]:
            doc, bucket = features(texts)
            at = np.minimum(np.searchsorted(buckets, bucket), max(0, len(buckets) - 1))
            hit = buckets[at] == bucket if len(buckets) else np.zeros(len(bucket), bool)
            return [x.tolist() for x in np.split(at[hit], np.searchsorted(doc[hit], np.arange(1, len(texts))))]

        for batch in batches:
            for block in blocks(batch, most=BLOCK):
                texts = block.column("text").to_pylist()
                pairs = [(at, pair) for at, text in enumerate(texts) for pair in swapper.twins(text)]
                told = kept([side for _, pair in pairs for side in pair]) if pairs else []
                twins: list[list[list[int]]] = [[] for _ in texts]
                for (at, _), one, other in zip(pairs, told[::2], told[1::2], strict=True):
                    twins[at].append([*(v + 1 for v in sorted({*one} - {*other})), *(-v - 1 for v in sorted({*other} - {*one}))])
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("label"), pa.array(kept(texts), kind), pa.array(twins, pa.list_(kind))], ["doc_id", "label", "x", "twins"])

    data = rows.mapInArrow(encode, "doc_id long, label int, x array<int>, twins array<array<int>>").toPandas().sort_values("doc_id")
    twins = [np.asarray(v, np.int64) for row in data["twins"] for v in row if len(v)]
    return fit([np.asarray(v, np.int64) for v in data["x"]], twins, data["label"].to_numpy(float), buckets, penalty)


def score(documents: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``documents`` with a column ``into``: how likely a text is toxic (a column of that name is replaced)."""
    ship(documents.sparkSession)
    documents = documents.drop(into)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, most=BLOCK):
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(model.score(block.column("text").to_pylist()), pa.float64())], [*names, into])

    return documents.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + f", `{into}` double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
