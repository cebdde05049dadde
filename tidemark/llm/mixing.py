"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies of each of its documents that gives it its target share of the mixture.  A
hash of the document and a seed gives a uniform number; the Poisson distribution of that rate, inverted there, gives the
document's count.  Each document is repeated by its count, and the copies are shuffled globally by a hash of their own.
The result is the same for any partitioning and after any retry.

Defined results: a null source is a source of its own; sources that are not weighted get ``rest``; a source of weight 0
gives no rows; rows of equal id have equal counts; a null id is an empty one; an empty table gives no rows; the columns
``replica``, ``rate`` and ``shuffle_key`` replace columns of those names, and all others are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, unused

SEED = 20_240
#: Sources up to which their rates are broadcast; beyond, the join is dealt by source and a salt.
MOST_SOURCES, SALTS = 10_000, 64


def hashed(*parts: Column, digits: int) -> Column:
    """The first hexadecimal digits of an MD5 over ``parts``, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, digits), 16, 10).cast("long")


def cumulative(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, to where the tail is below any uniform number."""
    most = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate / k)
        p = acc["p"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), p.alias("p"), F.array_append(acc["all"], p).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["all"])).otherwise(F.array(F.lit(1.0)))


def rates(documents: DataFrame, weights: Mapping[str, float] | None = None, rest: float = 1.0, tempered: float | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rate, cdf): ``epochs`` is the size of the mixture in rows, as a multiple of the table's.

    Weights: of ``weights``, else ``rest``; or, if ``tempered`` is given, a source's number of rows to that power.
    """
    sizes = documents.groupBy("source").agg(F.count("*").alias("n"))
    if tempered is not None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(tempered)))
    else:
        weight = F.lit(float(rest))
        for source, value in (weights or {}).items():
            weight = F.when(F.col("source") == source, F.lit(float(value))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    rows, total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rate = F.lit(float(epochs)) * F.lit(float(rows)) * F.col("weight") / F.lit(float(total)) / F.col("n") if total > 0 else F.lit(0.0)
    return sizes.select("source", rate.alias("rate")).withColumn("cdf", cumulative(F.col("rate")))


def mix(documents: DataFrame, weights: Mapping[str, float] | None = None, rest: float = 1.0, tempered: float | None = None, epochs: float = 1.0, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """The mixture: rows of ``documents`` with rate, replica (from 0) and shuffle_key, in the global order of the last."""
    documents = documents.drop("rate", "replica", "shuffle_key")
    names = documents.columns
    own, cdf, salt, count, rate = unused(documents, "_source", "_cdf", "_salt", "_count", "_rate")
    found = rates(documents, weights, rest, tempered, epochs).toDF(own, rate, cdf)
    known = found.limit(MOST_SOURCES + 1).collect()  # bounded: one row for each source, no more than this
    if len(known) <= MOST_SOURCES:
        held = documents.sparkSession.createDataFrame([tuple(row) for row in known], found.schema)
        joined = documents.join(F.broadcast(held), F.col("source").eqNullSafe(F.col(own)))
    else:
        salted = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = documents.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, (dealt[salt] == salted[salt]) & F.col("source").eqNullSafe(F.col(own))).drop(salt)
    id_ = F.coalesce(F.col(key).cast("string"), F.lit(""))
    uniform = (hashed(F.lit(str(seed)), id_, digits=13).cast("double") + 0.5) / F.lit(float(1 << 52))
    copies = joined.withColumn(count, F.size(F.filter(cdf, lambda c: c <= uniform))).filter(F.col(count) > 0)
    copies = copies.select(*(F.col(f"`{name}`") for name in names), F.col(rate).alias("rate"), F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias("replica"))
    keyed = copies.withColumn("shuffle_key", hashed(F.lit(str(seed)), id_, F.col("replica").cast("string"), digits=15))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources to equal shares, as many rows as the table has in the mean."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.round("rate", 9).alias("rate"), "replica", "shuffle_key", "text")


ORACLE_SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM sizes)::DOUBLE * 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE / n AS rate FROM sizes
), terms AS (
  SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k)
), cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
keyed AS (
  SELECT *, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents
), counted AS (
  SELECT d.doc_id, d.source, d.text, r.rate, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS n
  FROM keyed d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, source, round(rate, 9) AS rate, replica::INTEGER AS replica,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || replica), 1, 15))::BIGINT AS shuffle_key, text
FROM counted, LATERAL (SELECT unnest(range(0, n)) AS replica)
"""
