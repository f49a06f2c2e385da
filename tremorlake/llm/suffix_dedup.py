"""Repeated-passage removal by bucket-pointer refinement over sampled suffixes.

Every string of ``length`` bytes that starts in two places goes.  Identifiers
of byte strings double as in bucket-pointer refinement: the identifier of 2h
bytes at a position is made from the identifiers of h bytes there and h bytes
further on, and the results are used again for the next doubling; any longer
string is named by two of them.

Of all suffixes only anchors are bucketed: a window of ``length`` bytes is
named by the q-gram with the least identifier in it (the first of equals), so
equal windows have equal anchors at equal offsets.  Buckets of one anchor are
final.  The rest is refined:

1. all windows that share an anchor form one stretch; a stretch that occurs
   twice is repeated as a whole;
2. in buckets that still mix different stretches, the offsets of the windows
   are split into parts of 49, 7 and 1.  What all windows of a part have in
   common (the core) must occur in two stretches, or the part is final; a part
   that occurs twice as a whole is repeated; other parts are split again.

Identifiers have 64 bits; two different strings get the same one with
probability 2^-64.  Positions of a bucket never meet in pairs: every step is
a count by identifier.  Texts are laid out once by document (a bucketed
table) and joined there with their findings.

Defined results: a NULL text is empty; texts shorter than ``length`` lose
nothing; a text held by two rows is repeated as a whole; rows of the same
(doc_id, text) get the same result each; other columns are never read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import shuffle_width, table_name, written

U = np.uint64
_M1, _M2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: bytes worked on at a time, below 2^24 as positions share a word with an identifier's high bits
SLAB = 1 << 21
SPLITS = (49, 7, 1)


def _join(a: np.ndarray, b) -> np.ndarray:
    """Identifier of a string from those of two parts of it."""
    h = a * _M1
    h += b
    h ^= h >> U(32)
    h *= _M2
    h ^= h >> U(29)
    return h


def identifiers(data: bytes, upto: int) -> dict[int, np.ndarray]:
    """Identifiers of the 2^k bytes at every position, from 8 to ``upto`` bytes (the end is padded with zeros)."""
    n = len(data)
    buf = data + bytes(2 * upto + 8)
    ids = _join(np.ndarray((n + 2 * upto,), "<u8", buf, strides=(1,)).copy(), U(7))
    out, size = {8: ids}, 8
    while size < upto:
        ids = _join(ids[:-size], ids[size:])
        size *= 2
        out[size] = ids
    return out


def name_strings(ids: dict[int, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Identifiers of the strings [start, end): their first and last 2^k bytes (2^k: half of it at least)."""
    size = end - start
    out = np.zeros(len(start), U)
    for k, own in ids.items():
        here = (size >= k) & ((size < 2 * k) | (2 * k not in ids))
        s, e = start[here], end[here]
        out[here] = _join(_join(own[s], own[e - k]), (e - s).astype(U))
    return out


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys: prefix and suffix minima of blocks."""
    m = len(keys) - width + 1
    if m <= 0:
        return keys[:0]
    x = np.concatenate([keys, np.full(-len(keys) % width, U(2 ** 64 - 1))]).reshape(-1, width)
    before = np.minimum.accumulate(x, axis=1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:m], before[width - 1:width - 1 + m])


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches of the texts laid end to end: (text, first start, last start, anchor, bucket, stretch identifier)."""
    width = length - gram + 1
    top = 1 << (length + width - 1).bit_length() - 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = b"".join(texts)
    n = len(data)
    ids = identifiers(data, top)
    value = ids[gram]
    keys = (value[:n] >> U(24) << U(24)) | np.arange(n, dtype=U)
    at = (_least(keys, width) & U(0xFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(at)]
    start = np.flatnonzero(np.arange(len(at)) + length <= ends[owner])
    at, owner = at[start], owner[start]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool),
                                           (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([first[1:], [len(at)]])[:len(first)] - 1
    low, high, where, owner = start[first], start[last], at[first], owner[first]
    bucket = value[where]
    whole = _join(_join(name_strings(ids, low, high + length), (where - low).astype(U)), bucket)
    begin = (ends - sizes)[owner]
    return owner, low - begin, high - begin, where - begin, bucket, _join(whole, (where - high).astype(U))


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of about SLAB bytes: (text, offset, bytes); a long text in pieces overlapping by length - 1."""
    owner, base, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), SLAB):
            piece = t[a:a + SLAB + length - 1]
            owner.append(i)
            base.append(a)
            held.append(piece)
            size += len(piece)
            if size >= SLAB:
                yield owner, base, held
                owner, base, held, size = [], [], [], 0
    if held:
        yield owner, base, held


class Refinement:
    """The steps over one written layout of the texts."""

    def __init__(self, docs: DataFrame, length: int, gram: int):
        if gram < 8 or gram & (gram - 1) or not gram < length <= gram + 342:
            raise ValueError("gram: a power of two from 8 on, below length and not more than 342 below it")
        self.spark, self.length, self.gram = docs.sparkSession, length, gram
        buckets = shuffle_width(self.spark)
        ident = F.col("doc_id").cast("long")
        rows = docs.select(ident.alias("given_id"), F.coalesce(ident, F.lit(0)).alias("doc_id"),
                           F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
        rows = rows.withColumn("tag", F.xxhash64("body"))
        name = table_name("suffix_texts")
        (rows.repartition(buckets, "doc_id", "tag").write.format("parquet").option("compression", "zstd")
         .bucketBy(buckets, "doc_id", "tag").saveAsTable(name))
        self.texts = self.spark.table(name)

    def find_anchors(self) -> DataFrame:
        """``(doc_id, tag, low, high, anchor, bucket, stretch)``: one row per stretch of windows with one anchor."""
        length, gram = self.length, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                doc, tag = b.column(0), b.column(1)
                for owner, base, held in _pieces(b.column(2).to_pylist(), length):
                    which, low, high, at, bucket, stretch = anchors(held, length, gram)
                    row, base = pa.array(np.array(owner)[which]), np.array(base)[which]
                    yield pa.RecordBatch.from_arrays(
                        [doc.take(row), tag.take(row), pa.array(low + base), pa.array(high + base), pa.array(at + base),
                         pa.array(bucket.view(np.int64)), pa.array(stretch.view(np.int64))],
                        ["doc_id", "tag", "low", "high", "anchor", "bucket", "stretch"])

        return self.texts.select("doc_id", "tag", "body").filter(F.octet_length("body") >= length).mapInArrow(
            run, "doc_id long, tag long, low long, high long, anchor long, bucket long, stretch long")

    def snippets(self, live: DataFrame) -> DataFrame:
        """``(stretch, n, least, most, body)``: the bytes of each live stretch, read from one of its places."""
        length = self.length
        wanted = live.groupBy("doc_id", "tag").agg(
            F.collect_list(F.struct("stretch", "n", "low", "high", "anchor")).alias("wanted"))
        places = (self.texts.join(wanted, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"])
                  .select("body", F.explode("wanted").alias("w")))
        return places.select("w.stretch", "w.n", (F.col("w.anchor") - F.col("w.high")).cast("int").alias("least"),
                             (F.col("w.anchor") - F.col("w.low")).cast("int").alias("most"),
                             F.substring("body", (F.col("w.low") + 1).cast("int"),
                                         (F.col("w.high") - F.col("w.low") + length).cast("int")).alias("body"))

    def parts(self, bodies: DataFrame, size: int) -> DataFrame:
        """``(stretch, n, part, core, whole)``: identifiers of a stretch's parts of ``size`` offsets.

        ``bodies`` has the parts of the step before in ``parents`` (their
        first offsets, each over ``parent`` offsets).  ``whole`` is NULL where
        the stretch does not hold all windows of the part.
        """
        length, width = self.length, self.length - self.gram + 1
        parent = {49: 343, 7: 49, 1: 7}[size]
        top = 1 << (length + width - 1).bit_length() - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, 1024):
                    s = b.slice(a, 1024)
                    bodies = s.column(4).to_pylist()
                    base = np.cumsum([0, *map(len, bodies)])[:-1]
                    least, most = (s.column(i).to_numpy().astype(np.int64) for i in (2, 3))
                    parents = s.column(5)
                    row = np.repeat(np.arange(len(bodies)), parents.value_lengths().to_numpy())
                    first = parents.flatten().to_numpy().astype(np.int64)
                    part = (first[:, None] + np.arange(0, parent, size)).ravel()
                    row = np.repeat(row, parent // size)
                    final = np.minimum(part + size, width) - 1
                    meet = (part <= most[row]) & (final >= least[row])
                    row, part, final = row[meet], part[meet], final[meet]
                    anchor = base[row] + most[row]
                    ids = identifiers(b"".join(bodies), top)
                    core = _join(name_strings(ids, anchor - part, anchor - final + length), part.astype(U))
                    inside = (part >= least[row]) & (final <= most[row])
                    whole = np.zeros(len(row), U)
                    whole[inside] = _join(name_strings(ids, (anchor - final)[inside], (anchor - part + length)[inside]),
                                          core[inside])
                    pick = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [s.column(0).take(pick), s.column(1).take(pick), pa.array(part.astype(np.int32)),
                         pa.array(core.view(np.int64)), pa.array(whole.view(np.int64), mask=~inside)],
                        ["stretch", "n", "part", "core", "whole"])

        return bodies.select("stretch", "n", "least", "most", "body", "parents").mapInArrow(
            run, "stretch long, n long, part int, core long, whole long")

    def repeated(self) -> DataFrame:
        """``(doc_id, tag, first, last)``: ranges of window starts whose windows start elsewhere, too."""
        width = self.length - self.gram + 1
        found = written(self.find_anchors(), "suffix-anchors")
        place = F.struct("doc_id", "tag", "low", "high", "anchor")
        kinds = written(found.groupBy("bucket", "stretch")
                        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), "suffix-stretches")
        often = kinds.filter("n > 1").select("stretch")
        ranges = [found.join(often, "stretch").select("doc_id", "tag", F.col("low").alias("first"),
                                                      F.col("high").alias("last"))]
        # the counts are written before they are joined: Spark splits a large bucket between tasks only then
        mixed = written(kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("rarest"))
                        .filter("kinds > 1 AND rarest = 1").select("bucket"), "suffix-mixed")
        live = written(kinds.join(mixed, "bucket").select("stretch", "n", "at.*"), "suffix-live")
        name = table_name("suffix_snippets")
        (self.snippets(live).repartition(shuffle_width(self.spark), "stretch").write.format("parquet")
         .option("compression", "zstd").bucketBy(shuffle_width(self.spark), "stretch").saveAsTable(name))
        bodies = self.spark.table(name)
        at_work = bodies.withColumn("parents", F.array(F.lit(0)))
        for size in SPLITS:
            parts = written(self.parts(at_work, size), "suffix-parts")
            inside = parts.filter("whole IS NOT NULL")
            twice = written(inside.groupBy("whole").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
                            .select("whole", F.lit(True).alias("twice")), "suffix-twice")
            cols = ["stretch", "n", "part", "core"]
            judged = written(
                inside.join(twice, "whole", "left")
                .select(*cols, ((F.col("n") > 1) | F.coalesce("twice", F.lit(False))).alias("known"))
                .unionByName(parts.filter("whole IS NULL").select(*cols, (F.col("n") > 1).alias("known"))),
                "suffix-judged")
            places = live.filter("n = 1").select("stretch", "doc_id", "tag", "anchor")
            ranges.append(judged.filter("n = 1 AND known").join(places, "stretch").select(
                "doc_id", "tag", (F.col("anchor") - F.least(F.col("part") + size, F.lit(width)) + 1).alias("first"),
                (F.col("anchor") - F.col("part")).alias("last")))
            if size > 1:
                open_cores = written(judged.groupBy("core")
                                     .agg(F.count(F.lit(1)).alias("m"), F.min(F.col("known").cast("int")).alias("all"))
                                     .filter("m > 1 AND all = 0").select("core"), "suffix-cores")
                again = judged.join(open_cores, "core").groupBy("stretch").agg(F.collect_list("part").alias("parents"))
                at_work = bodies.join(again, "stretch")
        out = ranges[0]
        for r in ranges[1:]:
            out = out.unionByName(r)
        return out


def repeated_spans(starts: list[tuple[int, int]], length: int, size: int) -> list[tuple[int, int]]:
    """Union of the windows from ranges of starts: maximal [begin, end) spans of bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        end = min(b + length, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((a, end))
    return out


def suffix_dedup(docs: DataFrame, length: int = 400, gram: int = 64) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: removed [start, end) byte spans and the remaining bytes of every row."""
    work = Refinement(docs, length, gram)
    ranges = (work.repeated().groupBy("doc_id", "tag")
              .agg(F.collect_list(F.struct("first", "last")).alias("starts"))
              .withColumnsRenamed({"doc_id": "d", "tag": "t"}))
    joined = work.texts.join(ranges, (F.col("doc_id") == F.col("d")) & (F.col("tag") == F.col("t")), "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                s = b.slice(a, 512)
                sizes, spans, kept = [], [], []
                for body, starts in zip(s.column(1).to_pylist(), s.column(2).to_pylist()):
                    cut = repeated_spans([(x["first"], x["last"]) for x in starts or ()], length, len(body))
                    edges = [0, *(e for x in cut for e in x), len(body)]
                    sizes.append(len(body))
                    spans.append([{"start": x, "end": y} for x, y in cut])
                    kept.append(b"".join(body[x:y] for x, y in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span),
                                                  pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.select(F.col("given_id").alias("doc_id"), "body", "starts").mapInArrow(
        run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


