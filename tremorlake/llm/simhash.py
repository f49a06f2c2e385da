"""SimHash near-dedup: segment popcounts as an embedding, grid join under the Manhattan distance, exact check.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to its
vector of bit counts (0, 1 or 2).  The Manhattan distance of two vectors never
exceeds the Hamming distance of the fingerprints.  Counts are held in unary
(low bit: any bit set, high bit: both set), so the Manhattan distance is the
popcount of an XOR.

Grid: the 32 coordinates form ``GROUPS`` groups.  Vectors within Manhattan
distance d differ in at most d groups, so they share a cell for some choice
of GROUPS - d groups.  A fingerprint has one cell per choice, and candidate
pairs meet by an equi-join on the cell.

Dense cells are not multiplied out.  First each member of a cell is checked
against two of the cell's members (its smallest and largest fingerprint),
which settles cells of two, and the components of these links are found; only
members outside the component of their cell's first pivot are then joined with
the cell, and only pairs of different components are verified.  Every link between components is found,
so the components are exact.  Joins on the cell are merge joins: a side has a
row per cell of a fingerprint, which Spark's size estimate does not know.

Defined results: a NULL or blank text has fingerprint 0 and is linked like
any other; fewer words than a shingle are one shingle; repeated rows of a
doc_id are reported each; NULL doc_ids get the smallest real doc_id of their
component (NULL if none); other columns are never read; an empty table gives
no rows.  Dropping keeps one row of each component, whatever its doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import connected_components, shuffle_width, slices, written

GROUPS = 8
_LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int) -> int:
    """Bit i is set if it is set in over half of the XXH64 hashes of all word shingles (as a signed long)."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lowers A-Z only, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(joined, 42), "big", signed=True)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 18):
        hashes = [digest(joined[s:e - 1], 42) for s, e in zip(starts[a:min(n, a + (1 << 18))], starts[a + shingle:])]
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int, row: Column | None = None) -> DataFrame:
    """``(doc_id, fp)`` with fp a signed 64-bit long; with ``row`` (a long) also that as ``row``."""
    names = ["doc_id", "fp", *(["row"] if row is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *([row.alias("row")] if row is not None else [])) \
        .mapInArrow(run, ", ".join(f"{n} long" for n in names))


def unary_counts(fp: Column) -> Column:
    """Per two-bit segment: low bit if its count is at least 1, high bit if it is 2."""
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(F.lit(_LOW)).bitwiseOR(
        F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(_LOW)), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cell_masks(max_bits: int, groups: int = GROUPS) -> list[int]:
    """One mask per choice of ``groups - max_bits`` groups of coordinates."""
    edges = [64 * g // groups // 2 * 2 for g in range(groups + 1)]
    part = [((1 << edges[g + 1]) - 1) ^ ((1 << edges[g]) - 1) for g in range(groups)]
    return [_signed(sum(part[g] for g in pick)) for pick in combinations(range(groups), groups - max_bits)]


def cells(fps: DataFrame, max_bits: int, groups: int) -> DataFrame:
    """``(cell, fp)``: the grid cells of every fingerprint."""
    keys = [F.xxhash64(F.lit(i), F.col("u").bitwiseAND(F.lit(m))) for i, m in enumerate(cell_masks(max_bits, groups))]
    spread = fps.repartition(shuffle_width(fps.sparkSession), "fp")  # a row becomes many
    return (spread.select("fp", unary_counts(F.col("fp")).alias("u"))
            .select("fp", F.explode(F.array(*keys)).alias("cell")))


def near(a: str, b: str, max_bits: int) -> Column:
    """Manhattan distance of the embeddings as the bound, then the exact Hamming distance."""
    x, y = F.col(a), F.col(b)
    return ((F.bit_count(unary_counts(x).bitwiseXOR(unary_counts(y))) <= max_bits)
            & (F.bit_count(x.bitwiseXOR(y)) <= max_bits))


def fingerprint_components(fps: DataFrame, max_bits: int = 4, groups: int = GROUPS) -> DataFrame:
    """Components of distinct fingerprints ``fps(fp)`` linked at ``max_bits`` or fewer bits: ``(fp, comp)``.

    Fingerprints without a link are absent.
    """
    if not 0 <= max_bits < groups <= 32:
        raise ValueError("groups must exceed max_bits and be 32 at most")
    members = cells(fps, max_bits, groups)
    held = written(members.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"),
                                               F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-cells")
    # two in a cell: all is said by comparing them; more: each against the cell's smallest and largest
    pairs = held.filter((F.col("n") == 2) & near("lo", "hi", max_bits)).select(F.col("hi").alias("a"),
                                                                               F.col("lo").alias("b"))
    # merged: Spark sizes the cells by their fingerprints, before each becomes a row per cell, and would broadcast them
    shared = written(members.hint("merge").join(held.filter("n > 2").select("cell", "lo", "hi"), "cell"),
                     "simhash-members")
    to_lo = shared.filter((F.col("fp") != F.col("lo")) & near("fp", "lo", max_bits)).select(
        F.col("fp").alias("a"), F.col("lo").alias("b"))
    to_hi = shared.filter((F.col("fp") != F.col("hi")) & near("fp", "hi", max_bits)).select(
        F.col("fp").alias("a"), F.col("hi").alias("b"))
    first = connected_components(pairs.unionByName(to_lo).unionByName(to_hi).distinct())

    def labelled(df: DataFrame, col: str, out: str) -> DataFrame:
        lab = first.select(F.col("node").alias(col), F.col("comp").alias("_c"))
        return df.join(lab, col, "left").withColumn(out, F.coalesce("_c", col)).drop("_c")

    tagged = written(labelled(labelled(shared.select("cell", "fp", "lo"), "fp", "comp"), "lo", "lo_comp"),
                     "simhash-tagged")
    # a cell whose members all share the first pivot's component has nothing left to compare
    outside = tagged.filter(F.col("comp") != F.col("lo_comp")).select("cell", F.col("fp").alias("x"),
                                                                       F.col("comp").alias("x_comp"))
    inside = tagged.select("cell", F.col("fp").alias("y"), F.col("comp").alias("y_comp"))
    across = (outside.hint("merge").join(inside, "cell")
              .filter((F.col("x_comp") != F.col("y_comp")) & near("x", "y", max_bits))
              .select(F.least("x_comp", "y_comp").alias("a"), F.greatest("x_comp", "y_comp").alias("b")).distinct())
    second = connected_components(across)
    merged = second.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    nodes = first.select(F.col("node").alias("fp"), "comp").unionByName(
        second.select(F.col("node").alias("fp"), F.col("node").alias("comp"))
        .join(first.select(F.col("node").alias("fp")), "fp", "left_anti"))
    return nodes.join(merged, "comp", "left").select("fp", F.coalesce("top", "comp").alias("comp"))


def _components_with_first(rows: DataFrame, first: Column, max_bits: int, groups: int) -> DataFrame:
    """``(fp, first, comp)`` for every distinct fp of ``rows``; ``first`` is an aggregate over its rows."""
    distinct = written(rows.groupBy("fp").agg(first.alias("first")), "simhash-distinct")
    comps = fingerprint_components(distinct.select("fp"), max_bits, groups)
    return distinct.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, groups: int = GROUPS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; component_id is the smallest doc_id reachable over links."""
    rows = written(fingerprints(docs, shingle), "simhash-fps")
    tops = _components_with_first(rows, F.min("doc_id"), max_bits, groups)
    least = tops.groupBy("comp").agg(F.min("first").alias("component_id"))
    return rows.join(tops.join(least, "comp").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` (all columns) with one row of each component: the smallest doc_id, NULL last, its first row.

    Rows are told apart by a number that is written with them, so NULL and repeated ids stand for one row each.
    """
    numbered = written(docs.withColumn("__llm_row", F.monotonically_increasing_id()), "simhash-rows")
    rows = written(fingerprints(numbered, shingle, F.col("__llm_row")), "simhash-fps")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    keep = (_components_with_first(rows, first, max_bits, GROUPS).groupBy("comp").agg(F.min("first").alias("first"))
            .select(F.col("first.row").alias("__llm_row")))
    return numbered.join(keep, "__llm_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
