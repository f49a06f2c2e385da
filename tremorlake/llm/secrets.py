"""Secret scans by an incremental ledger of blobs.

Every text of every path and version is a blob, named by the SHA-256 of its
bytes.  The ledger holds one row per scanned (blob, rule, rule version), with
the spans found.  A scan asks the ledger which pairs it lacks, scans those
blobs once (one row stands for all copies of a text) for those rules alone,
appends the pairs, and joins the ledger's findings back to all rows.  A rule
whose version is raised is scanned again; the other rules' findings stay.

A run appends its pairs by one write; pairs that a broken run has not committed
are scanned by the next one.  If two runs scan a pair at a time, its findings
are equal and count once.

Defined results: a NULL text counts as empty; rows with a NULL or
repeated path keep the findings of their own text; repeated rows stay repeated; an empty table gives
no rows; the added columns ``digest`` and ``findings`` take the place of input
columns of the same names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import lookup_skewed, slices, written
from tremorlake.session import scratch_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap; those whose ``group`` is shorter than ``least`` are dropped."""

    name: str
    version: int
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False


#: Rules in the order in which spans of one start are listed.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2,
         any_case=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 32),  # the runs of `[0-9a-f]+` that are long enough
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 32),
)
BASE = ["assign", "access", "hex"]

SPANS = "array<struct<start:int,end:int>>"
PAIR = "digest binary, rule string, version int"


def compiled(rule: Rule) -> re.Pattern:
    """Either case means ASCII letters (no long s, no Kelvin sign)."""
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


def spans(rule: Rule, pattern: re.Pattern, text: str) -> list[dict[str, int]]:
    """Kept matches as code point offsets, end exclusive."""
    return [{"start": m.start(), "end": m.end()} for m in pattern.finditer(text)
            if m.end(rule.group) - m.start(rule.group) >= rule.least]


class Ledger:
    """Scanned pairs and their findings, Parquet files under ``path``; reopening the path continues."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_dir(spark, "secret-ledger")
        spark.createDataFrame([], f"{PAIR}, spans {SPANS}").write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{PAIR}, spans {SPANS}").parquet(self.path)

    def unseen(self, blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """``(digest, row, rules)``: blobs with the names of the rules whose pair the ledger lacks."""
        pairs = blobs.withColumn("r", F.explode(F.array(*[
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])))
        pairs = pairs.select("digest", "row", "r.rule", "r.version")
        return (pairs.join(self.read().select("digest", "rule", "version"), ["digest", "rule", "version"], "left_anti")
                .groupBy("digest").agg(F.first("row").alias("row"), F.collect_list("rule").alias("rules")))

    def add(self, found: DataFrame) -> None:
        found.write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """``(digest, findings)``: blobs with spans of the given rules and versions, by start and rule."""
        order = F.lit(len(rules))
        wanted = F.lit(False)
        for i, r in enumerate(rules):
            this = (F.col("rule") == r.name) & (F.col("version") == r.version)
            order, wanted = F.when(this, F.lit(i)).otherwise(order), wanted | this
        rows = self.read().filter(wanted).filter(F.size("spans") > 0)
        one = F.struct(F.col("s.start").alias("start"), order.alias("at"), "rule", F.col("s.end").alias("end"))
        listed = (rows.select("digest", "rule", "version", F.explode("spans").alias("s"))
                  .groupBy("digest").agg(F.sort_array(F.collect_set(one)).alias("f")))
        return listed.select("digest", F.transform("f", lambda s: F.struct(
            s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end"))).alias("findings"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(digest, rule, version, spans)`` of every listed rule for ``blobs(digest, rules, text)``."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = {r.name: (r, compiled(r)) for r in rules}
        for b in slices(batches, 512):
            out: dict[str, list] = {"digest": [], "rule": [], "version": [], "spans": []}
            for digest, wanted, text in zip(b.column(0), b.column(1), b.column(2)):
                content = text.as_py()
                for name in wanted.as_py():
                    rule, pattern = named[name]
                    for key, value in (("digest", digest.as_py()), ("rule", name), ("version", rule.version),
                                       ("spans", spans(rule, pattern, content))):
                        out[key].append(value)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["digest"], pa.binary()), pa.array(out["rule"], pa.string()),
                 pa.array(out["version"], pa.int32()), pa.array(out["spans"], kind)], ["digest", "rule", "version", "spans"])

    return blobs.select("digest", "rules", "text").mapInArrow(part, f"{PAIR}, spans {SPANS}")


def scan(versions: DataFrame, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES,
         ledger: Ledger | None = None) -> DataFrame:
    """Every row's ``path`` with ``digest`` of its text and ``findings`` (rule, start, end), by start and rule.

    A row is one version of a path; several rows of a path are several versions.
    """
    spark = versions.sparkSession
    ledger = ledger or Ledger(spark)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    # a row is told from other copies of its text by a hash of its path: copies spread over the join below
    tag = F.xxhash64(F.col(f"`{path}`"))
    rows = written(versions.select(F.col(f"`{path}`").alias("path"), digest.alias("digest"), tag.alias("row")),
                   "secret-rows")
    blobs = rows.groupBy("digest").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    blobs = written(blobs, "secret-blobs")
    unseen = written(ledger.unseen(blobs.select("digest", "row"), rules), "secret-unseen")
    texts = versions.select(digest.alias("digest"), tag.alias("row"), content.alias("text"))
    chosen = texts.join(unseen, ["digest", "row"])
    ledger.add(scan_blobs(chosen, rules))
    none = F.array().cast("array<struct<rule:string,start:int,end:int>>")
    known = blobs.join(ledger.findings(rules), "digest", "left").select(
        "digest", "n", F.coalesce("findings", none).alias("findings"))
    known = written(known, "secret-known")
    total = rows.count()
    return lookup_skewed(rows, known, ["digest"], "n", total).select(F.col("path").alias(path), "digest", "findings")
