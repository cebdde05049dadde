"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find.

1. Each text's set of word shingles gets a digest and a SuperMinHash signature, cut into bands.
2. Texts of equal sets form a class; its smallest document stands for it from here on.
3. Representatives that share a band key meet in a bucket.  Each is compared with the bucket pivot (smallest member) with
   which it shares most bands, on the full sets made anew from the texts; confirmed links are grouped.
4. Buckets whose members are still in different groups are searched on the signatures: members outside the pivot's group
   against all others, in chunks.  First each takes, in its largest bucket, the likeliest partner of another group in
   each chunk, which joins nearly all that belong together; then, of what is still apart, every pair that can reach the
   threshold is taken, in the first bucket that it shares: sizes and parity bitmaps of the sets rule out only pairs that
   provably lie below it.  These pairs are compared on full sets too.
5. Documents take the smallest document of their group.

A pair at the threshold misses all 32 bands with a probability of 5e-6; that is the only loss.  (The signature cut of the
first search of step 4 loses nothing: the second search takes up all that is still apart.)  No bucket is capped, no pair
of a group is made without a reason, and hot buckets, classes and groups are pre-aggregated or joined so that the adaptive
skew join can split them.

Defined results: a null text counts as empty; a text without words is linked with nothing; rows of equal doc_id and text
are copies; rows of one doc_id, or of none, with different texts are documents of their own, so that only near copies go; a
group is named after its smallest doc_id (null if no member has one), and ``kept`` marks the document that stays: of the
smallest doc_id, nulls last, then by a hash of the text; an empty table gives no rows; other columns are ignored, whatever
their names (:func:`deduplicate` keeps them; they must have an order, which maps do not); a single text takes about 25 times
its bytes in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, cut, drop, mark, table
from tidemark.llm.shingles import mix, shingle_sets, super_minhash
from tidemark.sources.shipping import ship

THRESHOLD = 75  # percent
BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS
#: Equal places that a partner needs in the first search of step 4, which only chooses what is compared early.
PLAUSIBLE = 80
#: A set's parity bitmap has the power of two from 4 bits a shingle on; sets that are not large have the bits of one of
#: LARGE shingles (64 at least), and no bitmap has more than MOST_BITS.
LARGE, MOST_BITS = 32, 1 << 16
#: Members of a bucket in a chunk of step 4, and words of the fixed-size filter of wanted documents (64 bits each).
CHUNK, FILTER_WORDS = 256, 1 << 19
BLOCK = 2 << 20

_BASE = "doc_id long, n long, set_a long, set_b long, keys array<long>, sig binary"


def describe(documents: DataFrame) -> DataFrame:
    """(doc_id, n, set_a, set_b, keys, sig) of each document: set size, digest, band keys, signature (8 bits a place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, most=BLOCK):
                rows = block.num_rows
                doc, value = shingle_sets(block.column("text").to_pylist())
                n = np.bincount(doc, minlength=rows)
                sums = []
                for salt in (0x1234567, 0x89ABCDEF01):
                    total = np.zeros(rows, np.uint64)
                    np.add.at(total, doc, mix(value ^ np.uint64(salt)))
                    sums.append(pa.array(total.view(np.int64)))
                sig = super_minhash(doc, value, rows, PLACES)
                keys = np.zeros((rows, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(0x9DDFEA08EB382D69) + sig[:, r::ROWS].astype(np.uint64))
                offsets = np.arange(rows + 1, dtype=np.int32) * BANDS
                small = mix(sig.astype(np.uint64)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"),
                        pa.array(n, pa.int64()),
                        *sums,
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64))),
                        pa.array([x.tobytes() for x in small], pa.binary()),
                    ],
                    ["doc_id", "n", "set_a", "set_b", "keys", "sig"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    return rows.mapInArrow(run, _BASE)


def only(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``documents`` whose id may be in ``ids``: a filter of fixed size (4 MB of bits) keeps the others' texts out
    of the shuffle; what it lets through in excess falls out of the join that follows."""
    word = lambda x: F.pmod(F.xxhash64(x), F.lit(FILTER_WORDS))
    bit = lambda x: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({x}, 1L), 64) as int))")
    bits = ids.select(word(F.col("id")).alias("_word"), bit("id").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = documents.withColumn("_word", word(F.col("doc_id"))).join(F.broadcast(bits), "_word")  # FILTER_WORDS rows at most
    return held.filter(F.col("_bits").bitwiseAND(bit("doc_id")) != 0).select("doc_id", "text")


def confirm(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: a written table) whose full sets reach the threshold; a pair may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, most=BLOCK):
                number: dict[str, int] = {}  # a pivot's text comes once in a block
                left = [number.setdefault(x.as_py() or "", len(number)) for x in block.column("text")]
                right = [number.setdefault(x.as_py() or "", len(number)) for x in block.column("pivot_text")]
                doc, value = shingle_sets(list(number))
                at = np.searchsorted(doc, np.arange(len(number) + 1))
                kept = []
                for x, y in zip(left, right, strict=True):
                    p, q = value[at[x] : at[x + 1]], value[at[y] : at[y + 1]]
                    small, large = min(len(p), len(q)), max(len(p), len(q))
                    common = len(np.intersect1d(p, q, assume_unique=True)) if 100 * small >= THRESHOLD * large else 0
                    kept.append(common > 0 and 100 * common >= THRESHOLD * (small + large - common))
                yield block.select(["a", "b"]).filter(pa.array(kept))

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = only(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    first = pairs.join(texts.withColumnRenamed("doc_id", "a"), "a")
    both = first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("pivot_text")), "b")
    return both.select("a", "b", "text", "pivot_text").mapInArrow(run, "a long, b long")


def groups(links: DataFrame) -> DataFrame:
    """(id, root) for each id in ``links`` (a, b): root is the smallest id that can be reached.

    Union-find in rounds: each root takes the smallest root that it is linked with as its parent, the paths are halved
    until all lead to a root, and the links move to the roots.  Every table is written, so that joins deal both sides
    anew and a hot root can be split, and so that a lost executor costs one round at most.
    """
    links = cut(links.select("a", "b").filter("a <> b").distinct())
    found = cut(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = cut(both.groupBy("a").agg(F.min("b").alias("b")).filter("b < a"))
        while True:
            up = parents.select(F.col("a").alias("b"), F.col("b").alias("c"))
            longer = cut(parents.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
            parents = longer.select("a", "b")
            if longer.filter("moved").isEmpty():
                break
        root = parents.select(F.col("a").alias("root"), F.col("b").alias("top"))
        found = cut(found.join(root, "root", "left").select("id", F.coalesce("top", "root").alias("root")))
        for end in ("a", "b"):
            links = links.join(root.withColumnRenamed("root", end), end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
        links = cut(links.filter("a <> b").distinct())
    return found


def bitmaps(documents: DataFrame) -> DataFrame:
    """(id, sig): for each text, which cells (of the shingles' hashes) hold an odd number of its shingles, a bit a cell.

    Where two bitmaps differ, a cell holds a shingle of one set alone, so two sets differ in at least as many shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, most=BLOCK):
                doc, value = shingle_sets(block.column("text").to_pylist())
                n = np.bincount(doc, minlength=block.num_rows)
                bits = np.array([min(MOST_BITS, 1 << int(4 * max(k, LARGE, 16) - 1).bit_length()) for k in n], np.int64)
                start = np.cumsum(bits) - bits
                cell = start[doc] + (mix(value) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
                packed = np.packbits((np.bincount(cell, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little")
                parts = [packed[x // 8 : (x + y) // 8].tobytes() for x, y in zip(start, bits, strict=True)]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(parts, pa.binary())], ["id", "sig"])

    return documents.mapInArrow(run, "id long, sig binary")


def differing(bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of rows, in how many places their bitmaps differ; the longer one is folded to the other's length."""
    lengths = np.array([len(b) for b in bits])
    shorter = np.minimum(lengths[x], lengths[y])
    out = np.zeros(len(x), np.int64)
    for size in np.unique(shorter):
        own = np.flatnonzero(shorter == size)
        used, at = np.unique(np.concatenate([x[own], y[own]]), return_inverse=True)
        held = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, size // 8), axis=0) for i in used])
        step = max(1, (4 << 20) // size)
        for i in range(0, len(own), step):
            one, two = at[: len(own)][i : i + step], at[len(own) :][i : i + step]
            out[own[i : i + step]] = np.bitwise_count(held[one] ^ held[two]).sum(axis=1, dtype=np.int64)
    return out


def _search(batches: Iterator[pa.RecordBatch], all_pairs: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of step 4 from rows (key, pc, bc, probe, id, root, n, sig, keys) in order of the first three.

    ``sig`` is a bitmap where all pairs are wanted, else a signature.
    """

    def pairs(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
        marks = np.stack([rows["key"], rows["pc"], rows["bc"]])
        edges = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1, [marks.shape[1]]])
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            own = slice(start, end)
            probe = rows["probe"][own]
            ids, roots, sizes, sig, keys = (rows[c][own] for c in ("id", "root", "n", "sig", "keys"))
            x, y = np.flatnonzero(probe), np.flatnonzero(~probe)
            if not len(x) or not len(y):
                continue
            # 100 * common >= 75 * union can hold only where the smaller set has three quarters of the larger one.
            may = (roots[x][:, None] != roots[y]) & (100 * np.minimum(sizes[x][:, None], sizes[y]) >= THRESHOLD * np.maximum(sizes[x][:, None], sizes[y]))
            at, to = np.nonzero(may)
            if all_pairs:
                first = np.concatenate([np.argmax(keys[x[at[i : i + 4096]]] == keys[y[to[i : i + 4096]]], axis=1) for i in range(0, max(1, len(at)), 4096)])
                here = keys[x[at], first] == rows["key"][start]
                at, to = at[here], to[here]
                # With d shingles in one set alone, 100 * common >= 75 * union is 175 * d <= 25 * (sum of the sizes).
                may = (100 + THRESHOLD) * differing(sig, x[at], y[to]) <= (100 - THRESHOLD) * (sizes[x[at]] + sizes[y[to]])
                at, to = at[may], to[may]
            else:
                equal = np.concatenate([(sig[x[at[i : i + 4096]]] == sig[y[to[i : i + 4096]]]).sum(axis=1) for i in range(0, max(1, len(at)), 4096)])
                kept = equal >= PLAUSIBLE
                at, to, equal = at[kept], to[kept], equal[kept]
                order = np.lexsort((ids[y[to]], -equal, at))
                at, to = at[order], to[order]
                lead = np.ones(len(at), bool)
                lead[1:] = at[1:] != at[:-1]
                at, to = at[lead], to[lead]
            p, q = ids[x[at]], ids[y[to]]
            out.append((np.maximum(p, q), np.minimum(p, q)))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "pc", "bc", "probe", "id", "root", "n")}
        rows["probe"] = rows["probe"].astype(bool)
        rows["sig"] = batch.column("sig").to_numpy(zero_copy_only=False)
        if not all_pairs:
            rows["sig"] = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(-1, PLACES)
        rows["keys"] = batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        last = (rows["key"] == rows["key"][-1]) & (rows["pc"] == rows["pc"][-1]) & (rows["bc"] == rows["bc"][-1])
        start = int(np.argmax(last))  # the last group may go on in the next batch; it has at most two chunks of rows
        held = {c: v[start:] for c, v in rows.items()}
        p, q = pairs({c: v[:start] for c, v in rows.items()})
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], ["a", "b"])
    if held is not None:
        p, q = pairs(held)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], ["a", "b"])


def still_apart(buckets: DataFrame, classes: DataFrame, found: DataFrame, documents: DataFrame, all_pairs: bool) -> DataFrame:
    """(a, b): pairs of a bucket in different groups of ``found`` (id, root) that may reach the threshold."""
    placed = cut(buckets.join(found, "id", "left").select("key", "id", "pivot", F.coalesce("root", "id").alias("root")))
    pivot_root = found.select(F.col("id").alias("pivot"), F.col("root").alias("pivot_root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("pivot").alias("pivot"), F.count("*").alias("m")).filter("low < high")
    mixed = cut(mixed.join(pivot_root, "pivot", "left").select("key", F.coalesce("pivot_root", "pivot").alias("pivot_root"), "m"))
    members = cut(placed.select("key", "id", "root").join(mixed, "key"))
    minor = members.filter("root <> pivot_root").select("key", "id", "m")
    if not all_pairs:
        minor = minor.groupBy("id").agg(F.max(F.struct("m", "key")).alias("top")).select("top.key", "id")
    minor = cut(minor.select("key", "id", F.lit(True).alias("minor")))
    minors = cut(minor.groupBy("key").agg(F.count("*").alias("minors")))
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("id"), chunks(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), chunks(n) - 1)
    members = members.join(minors, "key").join(minor, ["key", "id"], "left").withColumn("minor", F.coalesce("minor", F.lit(False)))
    members = cut(members.join(classes.select("id", "n", "sig", "keys"), "id"))

    if all_pairs:
        texts = only(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), members.select("id").distinct())
        members = members.drop("sig").join(cut(bitmaps(texts)), "id")
    fields = ["key", "id", "root", "n", "sig", "keys"]
    probes = members.filter("minor").select(*fields, mine("minors").alias("pc"), F.explode(every("m")).alias("bc"), F.lit(True).alias("probe"))
    others = members.select(*fields, F.explode(every("minors")).alias("pc"), mine("m").alias("bc"), F.lit(False).alias("probe"))
    dealt = probes.unionByName(others).repartition("key", "pc", "bc").sortWithinPartitions("key", "pc", "bc")
    return dealt.select("key", "pc", "bc", "probe", "id", "root", "n", "sig", "keys").mapInArrow(lambda batches: _search(batches, all_pairs), "a long, b long").distinct()


def numbered(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Numbers of documents: (``documents`` with _near_row, (doc_id: the number, text), (root: the number, component_id)).

    Where each row has an id of its own, that is the number, and the last table is None.  Else the distinct (doc_id, text)
    are numbered in their order, nulls last.
    """
    id_, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    marks = {"_near_null": id_.isNull(), "_near_id": F.coalesce(id_, F.lit(0)), "_near_a": F.xxhash64(text), "_near_b": F.xxhash64(F.lit(1), text)}
    counted = cut(documents.select(*(c.alias(name) for name, c in marks.items())).groupBy(*marks).agg(F.count("*").alias("copies")))
    if counted.groupBy("_near_null", "_near_id").agg(F.sum("copies").alias("n")).filter("_near_null OR n > 1").isEmpty():
        rows = documents.withColumn("_near_row", id_)
        return rows, rows.select(F.col("_near_row").alias("doc_id"), "text"), None
    numbers = cut(counted.orderBy(*marks).select(*marks, F.monotonically_increasing_id().alias("_near_row")))  # ascends with the order
    rows = documents.withColumns(marks).join(numbers, list(marks)).drop(*marks)
    texts = cut(rows.groupBy(F.col("_near_row").alias("doc_id")).agg(F.min(text).alias("text")))
    return rows, texts, numbers.select(F.col("_near_row").alias("root"), F.when(~F.col("_near_null"), F.col("_near_id")).alias("component_id"))


def near_rows(documents: DataFrame) -> DataFrame:
    """(id, n_shingles, root) of each of ``documents`` (doc_id: a number of its own, text)."""
    spark, since = documents.sparkSession, mark()
    ship(spark)
    base = cut(describe(documents))
    sets = ["set_a", "set_b", "n"]
    # Copies within a partition meet before the shuffle.
    head = F.min(F.struct("doc_id", "keys", "sig")).alias("head")
    classes = cut(base.filter("n > 0").groupBy(*sets).agg(head).select(F.col("head.doc_id").alias("id"), *sets, "head.keys", "head.sig"))

    rows = classes.select("id", F.explode("keys").alias("key"))
    pivots = cut(rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).filter("pivot < top").drop("top"))
    buckets = cut(rows.join(pivots, "key"))
    shared = buckets.filter("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("k"))
    best = shared.groupBy("id").agg(F.max(F.struct("k", (-F.col("pivot")).alias("p"))).alias("best"))
    tried = cut(best.select(F.col("id").alias("a"), (-F.col("best.p")).alias("b")))
    links = cut(confirm(tried, documents).distinct())
    found = groups(links)
    for all_pairs in (False, True):
        more = cut(still_apart(buckets, classes, found, documents, all_pairs).join(tried, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            tried = tried.unionByName(more)
            links = links.unionByName(cut(confirm(more, documents)))
            found = groups(links)

    named = cut(classes.select("id", *sets).join(found, "id", "left").select(*sets, F.coalesce("root", "id").alias("component_id")))
    drop(spark, since, [base, named])
    return base.select("doc_id", *sets).join(named, sets, "left").select(F.col("doc_id").alias("id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("root"))


def near_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    rows, texts, names = numbered(documents.select("doc_id", "text"))
    found = near_rows(texts)
    if names is None:
        return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("root").alias("component_id"), (F.col("id") == F.col("root")).alias("kept"))
    found = found.join(names, "root").select(F.col("id").alias("_near_row"), "n_shingles", "component_id", (F.col("id") == F.col("root")).alias("kept"))
    return rows.select("_near_row", F.col("doc_id").cast("long").alias("doc_id")).join(found, "_near_row").select("doc_id", "n_shingles", "component_id", "kept")


def deduplicate(documents: DataFrame) -> DataFrame:
    """``documents`` without the near copies: of each group the document with the smallest id stays, once.

    Of rows that differ in other columns alone the smallest stays.
    """
    packed = documents.select("doc_id", "text", F.struct(*(F.col(f"`{name}`") for name in documents.columns)).alias("whole"))
    rows, texts, _ = numbered(packed)
    kept = near_rows(texts).filter("id = root").select(F.col("id").alias("_near_row"))
    held = rows.select("_near_row", "whole").join(kept, "_near_row", "left_semi")
    return held.groupBy("_near_row").agg(F.min("whole").alias("whole")).select("whole.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


#: Shingles as lists of words; groups by passing the smallest id along the links.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[i:i + 4] AS s FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(id, other) AS (SELECT a, a FROM both_ways UNION SELECT reached.id, both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.other),
named AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN named ON named.id = d.doc_id
"""
