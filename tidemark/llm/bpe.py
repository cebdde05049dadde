"""BPE encoding and decoding through an index of pair occurrences.

The distinct words of a block of a partition are laid out in one array.  An index maps each adjacent pair that has a
rank to all its positions.  The active ranks are applied in ascending order: each takes its list of positions, merges
those that still hold the pair and enters the new neighbours into the lists of their own pairs.  As the words are
independent and no merge makes a pair of lower rank (checked when the file is read), every word ends as it would alone.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text; equal texts have equal
ids, and repeated rows are all kept; special strings inside texts become their ids, as the library does by default; an
empty table gives no rows; other columns are kept, whatever their names; a text of any length is one row of one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import word_bpe
from tidemark.llm.common import blocks, table
from tidemark.sources.shipping import ship

VOCABULARY = "word_bpe_49k.json"
#: Memory of the words whose ids a worker keeps, beyond which it starts anew, and of one such word besides its contents.
KEPT_BYTES, WORD_BYTES = 40 << 20, 180
#: Bytes of text in a block.
BLOCK = 2 << 20


def merge_words(bpe: word_bpe.WordBpe, words: list[str]) -> list[list[int]]:
    """The ids of each word."""
    ids: list[int] = []
    after: list[int] = []
    starts: list[int] = []
    for word in words:
        starts.append(len(ids))
        ids += bpe.start(word)
        after += range(len(after) + 1, len(ids) + 1)
        after[-1] = -1
    before = [-1, *range(len(ids) - 1)] if ids else []
    for at in starts:
        before[at] = -1

    rank, size, merges = bpe.rank, bpe.size, bpe.merges
    index: dict[int, list[int]] = {}
    for at in range(len(ids) - 1):
        if after[at] >= 0 and (r := rank.get(ids[at] * size + ids[at + 1])) is not None:
            if (held := index.get(r)) is None:
                index[r] = [at]
            else:
                held.append(at)
    active = list(index)
    heapify(active)
    while active:
        r = heappop(active)
        left, right, new = merges[r]
        for at in sorted(index.pop(r)):
            if ids[at] != left or (to := after[at]) < 0 or ids[to] != right:
                continue
            ids[at], ids[to], far = new, -1, after[to]
            after[at] = far
            if far >= 0:
                before[far] = at
                if (other := rank.get(new * size + ids[far])) is not None:
                    if (held := index.get(other)) is None:
                        index[other] = [at]
                        heappush(active, other)
                    else:
                        held.append(at)
            if (near := before[at]) >= 0 and (other := rank.get(ids[near] * size + new)) is not None:
                if (held := index.get(other)) is None:
                    index[other] = [near]
                    heappush(active, other)
                else:
                    held.append(near)
    out = []
    for at in starts:
        word = []
        while at >= 0:
            word.append(ids[at])
            at = after[at]
        out.append(word)
    return out


class Encoder:
    """Encodes blocks of texts; keeps the ids of words that it has seen, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.bpe = word_bpe.load(path)
        self._kept: dict[str, bytes] = {}
        self._held = 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.bpe.words(text or "") for text in texts]
        if self._held > KEPT_BYTES:
            self._kept.clear()
            self._held = 0
        kept = self._kept
        if not kept:
            kept.update({x: np.array([at], "<u4").tobytes() for x, at in self.bpe.specials.items()})
        unseen = [w for w in set().union(*split) if w not in kept]
        for word, ids in zip(unseen, merge_words(self.bpe, unseen), strict=True):
            kept[word] = np.array(ids, "<u4").tobytes()
            self._held += WORD_BYTES + len(word) + 4 * len(ids)
        return [b"".join(map(kept.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The file names no decoder, so the library joins the tokens by spaces."""
        return " ".join(map(self.bpe.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder; it outlives a task, and so do the words that it has seen."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column ``ids``: the token ids of ``text`` as an array (a column of that name is replaced)."""
    ship(df.sparkSession)
    df = df.drop(ids)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for block in blocks(batch, text, BLOCK):
                found = own.encode(block.column(text).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype("i4")
                flat = np.frombuffer(b"".join(found), "<u4").astype("i4")
                yield pa.RecordBatch.from_arrays([*block.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*names, ids])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{ids}` array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that ``ids`` decode to."""
    ship(df.sparkSession)
    df = df.drop(text)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            found = [own.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*names, text])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{text}` string")


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for block in blocks(batch, most=BLOCK):
                ids = own.encode(block.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": block.column("doc_id"),
                        "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                        "decoded_sha256": [hashlib.sha256(own.decode(x).encode("utf-8")).hexdigest() for x in ids],
                    }
                )

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
