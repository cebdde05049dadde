"""Document fingerprints by consistent weighted sampling, in built-in functions only.

The terms of a text are its lower-cased words, weighted by their number.  For each sample and term, hashes of the term
give r and c (gamma distributed, shape 2) and b (uniform); with t = floor(ln(weight) / r + b) the term's value is
ln c - r (t - b) - r, and the sample is the smallest value over the text's terms.  Two texts share a sample exactly if
they chose the same term at the same t, so the share of equal samples estimates the generalised Jaccard similarity of
their weights without bias.

Defined results: a null text is empty; an empty text (or one of white space alone) has an empty fingerprint, which is
like another empty one (1) and unlike all others (0); equal texts have equal fingerprints; repeated rows and ties of
doc_id go by text and are all kept; a null doc_id comes first; a table of one document has itself as the next; an empty
table gives no rows; other columns are ignored, whatever their names; a text of any length is one row (its words meet in
one task), and so do all rows of one doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

#: A likeness read off so many samples has a standard error of sqrt(p (1 - p) / SAMPLES): 0.08 at most.
SAMPLES = 40
#: Documents that a block of consecutive ids should have, the number of blocks from which on they should have more (one
#: row of each is broadcast), how much larger a block may be, and how often crowded blocks are divided.
BLOCK_ROWS, MOST_BLOCKS, CROWDED, LEVELS = 64, 262_144, 4, 16


def words(text: Column) -> Column:
    """The words of ``text``, lower-cased and sorted."""
    return F.sort_array(F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != ""))


def runs(values: Column) -> Column:
    """The last place of each run of equal values."""
    n = F.size(values)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == n - 1) | (F.get(values, i) != F.get(values, i + 1)))


def _unit(bits: Column) -> Column:
    """A number in (0, 1) of 32 bits."""
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 32))


def sample(term: Column, log_weight: Column, number: int) -> Column:
    """The value of a term in sample ``number``."""
    one = F.xxhash64(term, F.lit(number))
    two = F.xxhash64(one, F.lit(-1))
    high = lambda x: _unit(F.shiftrightunsigned(x, 32))
    low = lambda x: _unit(x.bitwiseAND(F.lit(0xFFFFFFFF)))
    r = -F.log(high(one) * low(one))
    c = -F.log(high(two) * low(two))
    b = high(F.xxhash64(two, F.lit(-2)))
    t = F.floor(log_weight / r + b).cast("double")
    return F.log(c) - r * (t - b) - r


def signatures(df: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, signature array<double>): a text for each key; null for a text without words.

    The grouping needs no shuffle where ``df`` is already dealt by some of ``keys``.
    """
    # One text's words are counted within its row; only distinct terms become rows.
    counted = df.select(*keys, words(F.col(text)).alias("_words")).withColumn("_runs", runs(F.col("_words")))
    before = lambda j: F.when(j == 0, F.lit(-1)).otherwise(F.get("_runs", j - 1))
    terms = F.transform("_runs", lambda e, j: F.struct(F.xxhash64(F.get("_words", e)).alias("h"), (e - before(j)).alias("n")))
    rows = counted.select(*keys, F.explode_outer(terms).alias("_term")).select(*keys, F.col("_term.h").alias("_h"), F.log(F.col("_term.n").cast("double")).alias("_w"))
    found = rows.groupBy(*keys).agg(*(F.min(sample(F.col("_h"), F.col("_w"), k)).alias(f"_s{k}") for k in range(samples)))
    return found.select(*keys, F.when(F.col("_s0").isNotNull(), F.array(*(f"_s{k}" for k in range(samples)))).alias("signature"))


def as_text(signature: Column) -> Column:
    """32 bits of each sample in hexadecimal."""
    code = F.transform(signature, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.xxhash64(x), 32))), 8, "0"))
    return F.coalesce(F.array_join(code, ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Estimated generalised Jaccard similarity of two signatures."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(samples))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def in_blocks(docs: DataFrame, id_: str = "id") -> DataFrame:
    """``docs`` with a column ``block``: blocks are disjoint ranges of ids.

    Ranges of equal width are divided again where they hold too many rows, so that outlying ids leave no block large;
    only rows of one id stay together.
    """
    low, high, n = docs.agg(F.min(id_), F.max(id_), F.count("*")).first()
    rows = max(BLOCK_ROWS, -(-n // MOST_BLOCKS))

    def part(low: Column, high: Column, parts: Column) -> Column:
        width = (high.cast("double") - low.cast("double") + 1.0) / parts
        return F.least(parts - 1, F.floor((F.col(id_).cast("double") - low.cast("double")) / width)).cast("string")

    docs = docs.withColumn("block", part(F.lit(low or 0), F.lit(high or 0), F.lit(max(1, -(-n // rows)))))
    for _ in range(LEVELS):
        ranges = docs.groupBy(F.col("block").alias("_block")).agg(F.count("*").alias("_n"), F.min(id_).alias("_low"), F.max(id_).alias("_high"))
        crowded = cut(ranges.filter((F.col("_n") > CROWDED * rows) & (F.col("_low") < F.col("_high"))))
        if crowded.isEmpty():
            break
        parts = F.ceil(F.col("_n") / rows)
        docs = docs.join(F.broadcast(crowded), F.col("block") == F.col("_block"), "left")  # CROWDED times fewer rows than blocks
        divided = F.concat_ws("/", "block", part(F.col("_low"), F.col("_high"), parts))
        docs = docs.withColumn("block", F.when(F.col("_block").isNull(), F.col("block")).otherwise(divided)).drop(*crowded.columns)
    return docs


def with_next(documents: DataFrame) -> DataFrame:
    """Blocks of consecutive documents: block, at (place in it), doc_id, text, next_text, extra.

    The first document of the next block that has any (after the last block: of the first) stands again at the end of
    each block, marked ``extra``, so that every document finds its successor in its own block.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low = docs.agg(F.min("doc_id")).first()[0] or 0
    docs = in_blocks(docs.withColumn("id", F.coalesce("doc_id", F.lit(low))))

    order = Window.orderBy("id")  # a row for each block
    firsts = docs.groupBy("block").agg(F.min("id").alias("id"))
    firsts = firsts.select("id", F.coalesce(F.lag("block").over(order), F.last("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    rows = docs.join(F.broadcast(firsts), "id", "left")
    places = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("block"), F.lit(True).alias("extra")))
    rows = rows.select("doc_id", "id", "text", F.explode(F.filter(places, lambda x: x["block"].isNotNull())).alias("place")).select("doc_id", "id", "text", "place.block", "place.extra")
    within = Window.partitionBy("block").orderBy("extra", "id", "doc_id", "text")
    return rows.repartition("block").select("block", F.row_number().over(within).alias("at"), "doc_id", "text", F.lead("text").over(within).alias("next_text"), "extra")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.coalesce(F.col("next_text").substr(F.lit(1), half), F.lit("")))
    both = F.when(F.col("extra"), F.array("text")).otherwise(F.array("text", edited))
    rows = docs.select("block", "at", "doc_id", "extra", n.cast("long").alias("n_chars"), F.posexplode(both).alias("which", "text"))
    rows = rows.withColumn("edited_sha256", F.when(F.col("which") == 1, F.sha2("text", 256)))
    # All that follows stays in the partitions of the blocks.
    signed = signatures(rows, ["block", "at", "doc_id", "extra", "n_chars", "which", "edited_sha256"], "text")
    own, new = (F.max(F.when(F.col("which") == w, F.col("signature"))) for w in (0, 1))
    paired = signed.groupBy("block", "at", "doc_id", "extra", "n_chars").agg(own.alias("own"), new.alias("edited"), F.max("edited_sha256").alias("edited_sha256"))
    after = F.lead("own").over(Window.partitionBy("block").orderBy("at"))
    return (
        paired.withColumn("after", after)
        .filter(~F.col("extra"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("own")).alias("fingerprint"),
            as_text(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("edited")).alias("near_edited"),
            likeness(F.col("own"), F.col("after")).alias("near_next"),
        )
    )
