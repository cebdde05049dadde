"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content.  A ledger records which rule versions have been
run over which blob.  A scan reads only the blobs for which some rule version is not in the ledger, runs only the
missing rules, appends what it found and joins the findings back to every path that holds the blob.

Defined results: a null text counts as empty; an empty text has no findings; equal texts share one scan and get equal
findings; a repeated path gets one row for each occurrence, and so does a null one; spans that start together are listed
in the order of the rules; an empty table gives no rows; other columns of the input are ignored (by redaction: kept),
whatever their names; a text of any length is scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table, unused
from tidemark.sources.shipping import ship


@dataclass(frozen=True)
class Rule:
    """``hints``: a text (lower-cased if ``fold``) without any of them has no match and skips the pattern."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()
    fold: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in the order in which ties of start are listed.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=12,
        hints=("password", "passwd", "secret", "token", "apikey", "api_key"),
        fold=True,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=18, hints=("AKIA",)),
    # A run that is shorter than 16 holds no match, so the bound may stand in the pattern.
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
#: What the ledger adds to the base kinds.
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hints=("-----BEGIN ",)),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hints=("eyJ",)),
    Rule("prefixed_key", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", hints=("gh", "xox", "sk_live_")),
)
RULES = BASE_RULES + MORE_RULES

_FINDING = "struct<start:int,rank:int,kind:string,version:int,end:int>"
LEDGER_SCHEMA = f"blob_id binary, scanned array<string>, findings array<{_FINDING}>"


def find(text: str, rules: tuple[Rule, ...], ranks: dict[str, int]) -> list[dict]:
    """All spans of ``rules`` in ``text``, by start, then rank of the kind; code points, end exclusive."""
    found, folded = [], None
    for rule in rules:
        if rule.hints:
            if rule.fold and folded is None:
                folded = text.lower()
            if not any(hint in (folded if rule.fold else text) for hint in rule.hints):
                continue
        for match in re.compile(rule.pattern, re.ASCII).finditer(text):
            if match.end(rule.group) - match.start(rule.group) >= rule.least:
                found.append({"start": match.start(), "rank": ranks[rule.kind], "kind": rule.kind, "version": rule.version, "end": match.end()})
    return sorted(found, key=lambda x: (x["start"], x["rank"], x["end"]))


def _pairs(rules: tuple[Rule, ...]):
    return F.array(*(F.lit(rule.key) for rule in rules))


def address(df: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob_id, text): each text under its content address."""
    return df.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob_id", F.unhex(F.sha2("text", 256)))


def merged(ledger: DataFrame) -> DataFrame:
    """One row for each blob of a ledger; each blob has as many rows as scans of it, so at most one for each rule version."""
    return ledger.groupBy("blob_id").agg(
        F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("scanned"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"),
    )


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for ``versions`` (of :func:`address`): of the blobs and rule versions that ``ledger`` lacks alone."""
    by_key, ranks = {rule.key: rule for rule in rules}, {rule.kind: at for at, rule in enumerate(rules)}
    ship(versions.sparkSession)

    # Copies within a partition meet before the shuffle, so a hot blob sends one row from each partition.
    blobs = versions.groupBy("blob_id").agg(F.first("text").alias("text")).withColumn("todo", _pairs(rules))
    if ledger is not None:
        # The ledger's rows come to the blobs, which are dealt by their id already; texts move once in all.
        known = merged(ledger).select("blob_id", F.col("scanned").alias("known"))
        missing = F.array_except("todo", F.coalesce("known", F.array().cast("array<string>")))
        blobs = blobs.join(known, "blob_id", "left").withColumn("todo", missing).filter(F.size("todo") > 0).drop("known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("blob_id", pa.binary()),
                ("scanned", pa.list_(pa.string())),
                ("findings", pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("version", pa.int32()), ("end", pa.int32())]))),
            ]
        )
        for batch in batches:
            todo = batch.column("todo").to_pylist()
            found = [find(text.as_py(), tuple(by_key[x] for x in keys), ranks) for text, keys in zip(batch.column("text"), todo, strict=True)]
            yield pa.RecordBatch.from_pydict({"blob_id": batch.column("blob_id").cast(pa.binary()), "scanned": todo, "findings": found}, schema=schema)

    return blobs.mapInArrow(run, LEDGER_SCHEMA)


def findings(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Findings of each path (one row for each row of ``versions``): path, blob_id, findings."""
    # Only blobs with findings are joined; they are written first, so that the adaptive skew join can split a hot blob's paths.
    found = cut(merged(ledger.filter(F.size("findings") > 0)).select("blob_id", "findings"))
    empty = F.array().cast(f"array<{_FINDING}>")
    return versions.select("path", "blob_id").join(found, "blob_id", "left").withColumn("findings", F.coalesce("findings", empty))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text, spans):
    """``text`` with each span replaced by ``[kind]``; spans that overlap an earlier one are merged into it."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    return F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))


def redact_documents(documents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``documents`` with secrets redacted; ``n_chars``, if there is one, follows the new texts."""
    names = documents.columns
    blob, spans = unused(documents, "_blob", "_spans")
    fresh = cut(scan(address(documents), ledger, rules))
    known = fresh if ledger is None else ledger.unionByName(fresh)
    found = cut(merged(known.filter(F.size("findings") > 0)).select(F.col("blob_id").alias(blob), F.col("findings").alias(spans)))
    joined = documents.withColumn(blob, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(found, blob, "left")
    joined = joined.withColumn("text", F.when(F.col(spans).isNotNull(), redact(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in names:
        joined = joined.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.select(*(F.col(f"`{name}`") for name in names))


#: Parts in which the query's table comes, one scan after the other.
DELIVERIES = 2


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table comes in deliveries; each extends the ledger by the blobs that earlier ones did not hold, and in the end
    the findings of all are joined to all paths."""
    versions = address(table(spark, sf_dir, "documents"))
    delivery = F.pmod(F.xxhash64("path"), F.lit(DELIVERIES))
    ledger = None
    for at in range(DELIVERIES):
        fresh = cut(scan(versions.filter(delivery == at), ledger))
        ledger = fresh if ledger is None else ledger.unionByName(fresh)
    found = findings(versions, ledger)
    base = [rule.kind for rule in BASE_RULES]
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"),
        *map(count, base),
        F.sha2(_joined(F.filter("findings", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
        F.lower(F.hex("blob_id")).alias("blob_id"),
    )


def _sql_spans(rule: Rule) -> str:
    """Spans of a rule in SQL: what stands between the matches gives their places."""
    pattern = rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")))
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {RULES.index(rule)} AS rank, unnest(regexp_split_to_array(text, '{pattern}')[:-2]) AS gap,
      unnest(regexp_extract_all(text, '{pattern}')) AS found, unnest(regexp_extract_all(text, '{pattern}', {rule.group})) AS held, {rule.least} AS least,
      unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS n FROM texts WHERE regexp_matches(text, '{pattern}')"""


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pieces AS ({" UNION ALL ".join(map(_sql_spans, RULES))}),
spans AS (
  SELECT doc_id, kind, rank, held, least, found, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, kind ORDER BY n) AS stop FROM pieces
), kept AS (SELECT doc_id, kind, rank, stop - length(found) AS start, stop FROM spans WHERE length(held) >= least),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (rank < {len(BASE_RULES)}) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans
  FROM kept GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob_id
FROM texts t LEFT JOIN listed l ON l.doc_id IS NOT DISTINCT FROM t.doc_id
"""
