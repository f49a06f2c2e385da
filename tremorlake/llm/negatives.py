"""Hard negatives of anchor vectors by angular triangle filtering, with integer scores.

Every vector is stored with its norm and its angles to a few reference
directions.  For an anchor at angle ``f`` and a row at angle ``t`` to the same
reference, the angle between both lies in ``[|f - t|, min(f + t, 2 pi - f - t)]``;
all references together give a cosine interval, which times both norms bounds
the score from both sides (widened for rounding).  Only pairs whose bounds meet
the anchor's window are scored in integers: for positives the scores above the
fifth best so far, for negatives those between the lower limit of the anchor's
windows and its best positive.

Anchors are a fixed query set: they are written in blocks of about ``block``
rows, and every block meets all rows in one pass over the written vectors (two:
positives, then negatives).  A pass broadcasts one block; a task holds that
block and one piece of rows, and sends on the best ``keep`` rows it has seen
per anchor (and positive), so what is shuffled does not depend on how many rows
fall into a window.  No row is moved.

Defined results: rows with a NULL id, label or vector, or an empty vector
or one with a null, NaN or infinite component, take no part; a score exists between vectors of the same
number of components only; a row with the anchor's own vec_id is no positive
or negative of it; repeated rows are candidates as often as they are there, but
one anchor; an anchor without positives, or without a row in its windows, has
no rows; a negative positive score has an empty window; an empty table gives no
rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.llm.common import slices, written
from tremorlake.llm.vectors import floored, matrix, usable
from tremorlake.session import scratch_dir

#: Widening of angles and (relative to both norms) of scores, far above the rounding of the 32-bit floats of the bounds.
ANGLE_SLACK, SCORE_SLACK = 4e-6, 1e-5
#: Products of norms up to this make integer scores that 64-bit floats hold exactly, whatever the order of the sum.
EXACT = float(1 << 52)


def prepared(rows: DataFrame, scale: int, label: Column) -> DataFrame:
    """``(vec_id, label, v, dims)`` of the rows that take part."""
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                       F.col("embedding"))
    kept = kept.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    return kept.select("vec_id", "label", floored(F.col("embedding"), scale).alias("v"),
                       F.size("embedding").alias("dims"))


def references(vectors: DataFrame, dims: int, count: int) -> np.ndarray:
    """Unit vectors of the ``count`` rows with the smallest hash: any directions are right, rows lie near others."""
    first = (vectors.filter((F.col("dims") == dims) & F.exists("v", lambda x: x != 0))
             .orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(count).collect())
    if not first:
        return np.zeros((0, dims))
    held = np.array([r["v"] for r in first], dtype=np.float64)
    return held / np.linalg.norm(held, axis=1, keepdims=True)


def angles(v: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to every direction (a zero vector's angle is any: its scores are 0)."""
    x = v.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    cosine = (x @ directions.T) / np.where(norm > 0, norm, 1.0)[:, None]
    return norm, np.arccos(np.clip(cosine, -1.0, 1.0))


def with_angles(vectors: DataFrame, dims: int, directions: np.ndarray) -> DataFrame:
    """The vectors of one dimension with ``norm`` and ``angles``."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            norm, theta = angles(matrix(b.column(2), dims), directions)
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column(0), "label": b.column(1), "v": b.column(2), "norm": pa.array(norm),
                "angles": pa.array(list(theta), pa.list_(pa.float64()))})

    return (vectors.filter(F.col("dims") == dims).select("vec_id", "label", "v")
            .mapInArrow(part, "vec_id long, label long, v array<int>, norm double, angles array<double>"))


@dataclass
class Block:
    """One block of anchors: number, id, label, vector, norm, angles of each."""

    no: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    norm: np.ndarray
    theta: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, dims: int, refs: int) -> Block:
        column = lambda c: table.column(c).combine_chunks()
        return cls(column("no").to_numpy(), column("vec_id").to_numpy(), column("label").to_numpy(),
                   matrix(column("v"), dims), column("norm").to_numpy(),
                   column("angles").flatten().to_numpy().reshape(len(table), refs))


@dataclass
class Piece:
    """A piece of the rows of a task."""

    vec_id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    norm: np.ndarray
    theta: np.ndarray

    @classmethod
    def of(cls, b: pa.RecordBatch, dims: int, refs: int) -> Piece:
        return cls(b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), dims), b.column(3).to_numpy(),
                   b.column(4).flatten().to_numpy().reshape(b.num_rows, refs))

    def sorted_by_reference(self) -> tuple[Piece, list[tuple[int, int]]]:
        """The piece with rows of one nearest reference together, and the runs."""
        if not self.theta.shape[1]:
            return self, [(0, len(self.norm))]
        near = self.theta.argmin(axis=1)
        order = np.argsort(near, kind="stable")
        cuts = np.flatnonzero(np.diff(near[order])) + 1
        ends = [0, *cuts.tolist(), len(order)]
        return Piece(*(x[order] for x in (self.vec_id, self.label, self.v, self.norm, self.theta))), \
            list(zip(ends, ends[1:]))


def score_bounds(low: np.ndarray, high: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores from angles in [low, high] and the product of both norms, rounded outwards."""
    slack = SCORE_SLACK * norms + 1.0
    return (np.cos(np.minimum(high + ANGLE_SLACK, np.pi)) * norms - slack,
            np.cos(np.maximum(low - ANGLE_SLACK, 0.0)) * norms + slack)


def integer_scores(a: np.ndarray, b: np.ndarray, exact: bool, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``i`` of a with the rows ``j`` of b.

    Many pairs of few rows are one matrix product, in floats where these are exact; few pairs are taken one by one.
    """
    if exact and len(i) * 16 > len(a) * len(b):
        return (a.astype(np.float64) @ b.astype(np.float64).T)[i, j].astype(np.int64)
    parts = [np.einsum("nd,nd->n", a[i[c:c + 16384]], b[j[c:c + 16384]]) for c in range(0, len(i), 16384)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def scored_pairs(block: Block, piece: Piece, runs: list[tuple[int, int]], same_label: bool, floor: np.ndarray,
                 ceiling: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor index, row index, score) of the pairs whose score bounds meet [floor, ceiling] of the anchor."""
    refs = piece.theta.shape[1]
    for a, z in runs:
        theta, norm = piece.theta[a:z], piece.norm[a:z]
        near, far = theta.min(axis=0, initial=np.pi), theta.max(axis=0, initial=0.0)
        # the run as a whole: no angle between an anchor and any of its rows is below `low`
        low = np.maximum(np.maximum(near - block.theta, block.theta - far), 0.0).max(axis=1, initial=0.0)
        longest, shortest = norm.max(), norm.min()
        cosine = np.cos(np.maximum(low - ANGLE_SLACK, 0.0))
        best = cosine * block.norm * np.where(cosine > 0, longest, shortest) + SCORE_SLACK * block.norm * longest + 1.0
        alive = np.flatnonzero(best >= floor)
        t = np.ascontiguousarray(theta.T.astype(np.float32))
        for s in range(0, len(alive), 256):
            some = alive[s:s + 256]
            f = block.theta[some].astype(np.float32)
            low = np.zeros((len(some), z - a), dtype=np.float32)
            high = np.full((len(some), z - a), np.pi, dtype=np.float32)
            for r in range(refs):
                one, other = f[:, r][:, None], t[r][None, :]
                np.maximum(low, np.abs(one - other), out=low)
                both = one + other
                np.minimum(high, np.minimum(both, np.float32(2 * np.pi) - both), out=high)
            norms = (block.norm[some][:, None] * norm[None, :]).astype(np.float32)
            least, most = score_bounds(low, high, norms)
            meets = (most >= floor[some][:, None]) & (least <= ceiling[some][:, None])
            meets &= (block.label[some][:, None] == piece.label[a:z][None, :]) == same_label
            meets &= block.vec_id[some][:, None] != piece.vec_id[a:z][None, :]
            i, j = np.nonzero(meets)
            if len(i):
                exact = block.norm[some].max() * longest < EXACT
                yield some[i], a + j, integer_scores(block.v[some], piece.v[a:z], exact, i, j)


class Best:
    """The ``keep`` best (score, then smaller id) of every key, updated piece by piece."""

    def __init__(self, keys: int, keep: int):
        self.keep = keep
        self.key, self.score, self.vec_id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.limit = np.full(keys, np.iinfo(np.int64).min)  # the last kept score of a full key

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        better = score >= self.limit[key]
        if not better.any():
            return
        key, score, vec_id = key[better], score[better], vec_id[better]
        key, score, vec_id = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.vec_id, vec_id)))
        order = np.lexsort((vec_id, -score, key))
        key, score, vec_id = key[order], score[order], vec_id[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        held = rank < self.keep
        self.key, self.score, self.vec_id = key[held], score[held], vec_id[held]
        full = rank == self.keep - 1
        self.limit[key[full]] = score[full]


def positives(rows: DataFrame, shared, dims: int, refs: int, keep: int) -> DataFrame:
    """``(no, score, vec_id)``: every task's best ``keep`` rows of the anchor's label."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best, ceiling = Best(len(block.no), keep), np.full(len(block.no), np.inf)
        for b in slices(batches, 2048):
            piece, runs = Piece.of(b, dims, refs).sorted_by_reference()
            for i, j, s in scored_pairs(block, piece, runs, True, best.limit.astype(np.float64), ceiling):
                best.add(i, s, piece.vec_id[j])
        yield pa.RecordBatch.from_pydict({"no": pa.array(block.no[best.key]), "score": pa.array(best.score),
                                          "vec_id": pa.array(best.vec_id)})

    return rows.mapInArrow(part, "no long, score long, vec_id long")


def negatives(rows: DataFrame, shared, dims: int, refs: int, keep: int, least: int) -> DataFrame:
    """``(no, slot, score, vec_id)``: every task's best ``keep`` rows of other labels within each positive's window."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tops = shared.value
        slots = tops.shape[1]
        best = Best(len(block.no) * slots, keep)
        open_ = tops >= 0  # an absent positive is held as -1, and a negative one has an empty window
        limit = tops // 100 * least - (-(tops % 100) * least // 100)  # least per cent, rounded up
        lower = np.where(open_, limit, np.iinfo(np.int64).max)
        ceiling = np.where(open_, tops, -1).max(axis=1).astype(np.float64)
        for b in slices(batches, 2048):
            piece, runs = Piece.of(b, dims, refs).sorted_by_reference()
            floor = np.maximum(lower, best.limit.reshape(-1, slots)).min(axis=1).astype(np.float64)
            for i, j, s in scored_pairs(block, piece, runs, False, floor, ceiling):
                for k in range(slots):
                    hit = (s >= lower[i, k]) & (s <= tops[i, k])
                    if hit.any():
                        best.add(i[hit] * slots + k, s[hit], piece.vec_id[j[hit]])
        yield pa.RecordBatch.from_pydict({
            "no": pa.array(block.no[best.key // slots]), "slot": pa.array(best.key % slots, pa.int32()),
            "score": pa.array(best.score), "vec_id": pa.array(best.vec_id)})

    return rows.mapInArrow(part, "no long, slot int, score long, vec_id long")


def top(df: DataFrame, key: list[str], keep: int, rank: str) -> DataFrame:
    """The best ``keep`` rows of every key with their rank from 1."""
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("vec_id"))
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= keep)


def mine_dimension(vectors: DataFrame, dims: int, anchor: Column, keep_positives: int, keep_negatives: int,
                   least: int, refs: int, block: int) -> DataFrame | None:
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    directions = references(vectors, dims, refs)
    refs = len(directions)
    rows = written(with_angles(vectors, dims, directions), "negatives-rows")
    anchors = rows.filter(anchor).dropDuplicates(["vec_id", "label", "v"])
    anchors = written(anchors.withColumn("no", F.monotonically_increasing_id()), "negatives-anchors")
    blocks = max(1, -(-anchors.count() // block))
    of_block = F.pmod(F.xxhash64("no"), F.lit(blocks))
    out = scratch_dir(spark, "negatives-found")
    for n in range(blocks):
        mine = Block.of(anchors.filter(of_block == n).toArrow(), dims, refs)  # about `block` rows: no is unique
        if not len(mine.no):
            continue
        shared = sc.broadcast(mine)
        found = top(positives(rows, shared, dims, refs, keep_positives), ["no"], keep_positives, "place")
        found = written(found, "negatives-positives")
        held = found.toArrow()  # `keep_positives` rows an anchor of the block
        tops = np.full((len(mine.no), keep_positives), -1, dtype=np.int64)
        index = {no: i for i, no in enumerate(mine.no.tolist())}
        for no, place, score in zip(*(held.column(c).to_pylist() for c in ("no", "place", "score"))):
            tops[index[no], place - 1] = max(score, -1)
        both = sc.broadcast((mine, tops))
        near = top(negatives(rows, both, dims, refs, keep_negatives, least), ["no", "slot"], keep_negatives, "rank")
        chosen = found.select("no", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"),
                              F.col("score").alias("positive_score"))
        ids = anchors.select("no", F.col("vec_id").alias("anchor_id"))
        result = (near.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
                  .join(chosen, ["no", "slot"]).join(ids, "no"))
        result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score") \
            .write.parquet(f"{out}/block={n}")
        shared.unpersist()
        both.unpersist()
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
              "negative_score long, block int")
    spark.createDataFrame([], schema.removesuffix(", block int")).write.parquet(f"{out}/block=-1")
    return spark.read.schema(schema).parquet(out).drop("block")


def hard_negatives(rows: DataFrame, anchor: Column, label: Column, scale: int = 256, keep_positives: int = 5,
                   keep_negatives: int = 5, least: int = 80, refs: int = 8, block: int = 4096) -> DataFrame:
    """Hard negatives of the rows where ``anchor`` (a condition on vec_id) holds.

    ``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``: for each of an anchor's best ``keep_positives`` rows of
    its label, the best ``keep_negatives`` rows of other labels whose score is
    between ``least`` per cent of the positive's score and that score.
    """
    vectors = written(prepared(rows, scale, label), "negatives-vectors")
    sizes = [r[0] for r in vectors.filter(anchor).select("dims").distinct().collect()]
    found = [mine_dimension(vectors, d, anchor, keep_positives, keep_negatives, least, refs, block)
             for d in sorted(sizes) if d]
    if not found:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                                     "positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, found)
