"""Stupid-backoff scores from n-gram counts partitioned by hash.

    S(w | u v) = c(u v w) / c(u v)       if c(u v w) >= min_count
                 a * S(w | v)            otherwise
    S(w | v)   = c(v w) / c(v)           if c(v w) >= min_count
                 a * c(w) / N            otherwise

and a document's score is the sum of log S over its words.  The counts are of
all documents.

Documents are laid out once in chunks of some megabytes, words as positions in
the chunk's vocabulary.  A chunk explodes into its distinct n-grams with their
numbers; these are grouped by order and hash range, where they are counted,
cut at ``min_count`` and joined: every chunk gets back the counts of its own
n-grams, in their order, and sums them per document.  What travels is one
entry per chunk and distinct n-gram (packed in arrays), so a frequent n-gram
has one entry per chunk however often it occurs, and a group holds about
``group_words`` entries whatever the corpus.

Words are maximal runs of non-blank characters (ASCII white space), A-Z
lower-cased.  N-grams are told apart by a hash of ``HASH_BITS`` bits.

Defined results: NULL or blank texts have no words and score 0; n-grams do
not cross documents; words that the corpus lacks count once; repeated rows
count and are scored each; other columns are never read; an empty table gives
no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import shuffle_width, table_name

U = np.uint64
HASH_BITS = 52
_M = U(0x9E3779B97F4A7C15)
LAYOUT = "chunk string, weight int, words long, docs array<long>, sizes array<int>, codes binary, vocabulary binary"


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers byte plane by byte plane, without the empty high planes (the first byte: planes kept)."""
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    planes = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([planes]) + wide[:, :planes].T.tobytes()


def _expand(raw: bytes) -> np.ndarray:
    planes = raw[0]
    got = np.frombuffer(raw, np.uint8, offset=1).reshape(planes, -1)
    wide = np.zeros((got.shape[1], 8), np.uint8)
    wide[:, :planes] = got.T
    return wide.reshape(-1).view("<u8")


def _lay_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, each word's position in the vocabulary, and the vocabulary's hashes."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten()
    row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(words), 0)
    row = row[real.to_numpy(zero_copy_only=False)]
    coded = pc.ascii_lower(words.filter(real)).dictionary_encode()
    keep = (1 << HASH_BITS) - 1
    names = np.fromiter((xxhash.xxh64_intdigest(w) & keep for w in coded.dictionary.to_pylist()), U,
                        len(coded.dictionary))
    return np.bincount(row, minlength=len(texts)), coded.indices.to_numpy(zero_copy_only=False), names


def _grams(words: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order from 1 on: hashes of the n-grams that end at each word, and whether the document has that n-gram."""
    place = np.arange(len(words), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    own = words
    for n in range(1, order + 1):
        if n > 1:
            before = np.concatenate([own[:1], own[:-1]])
            own = (before ^ U(n)) * _M + words
            own ^= own >> U(31)
            own = own * U(0xC2B2AE3D27D4EB4F) & U((1 << HASH_BITS) - 1)
            own ^= own >> U(27)
        yield own, place >= n - 1


def layout(docs: DataFrame, weight: int, chunk_bytes: int) -> DataFrame:
    """Chunks of documents; ``weight`` 1: their n-grams are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def chunk():
            t = pa.Table.from_batches(held).combine_chunks()
            text = t.column(1).cast(pa.large_string()).combine_chunks()
            sizes, codes, names = _lay_out(text)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([weight], pa.int32()), pa.array([len(codes)], pa.int64()),
                 pa.array([t.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                 pa.array([_squeeze(codes)], pa.binary()), pa.array([names.tobytes()], pa.binary())],
                ["chunk", "weight", "words", "docs", "sizes", "codes", "vocabulary"])

        for b in batches:
            step = max(1, int(b.num_rows * chunk_bytes / max(1, b.nbytes)))
            for a in range(0, b.num_rows, step):
                held.append(b.slice(a, step))
                size += b.nbytes * held[-1].num_rows // b.num_rows
                if size >= chunk_bytes:
                    yield chunk()
                    held, size = [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield chunk()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, LAYOUT)


def _positions(codes: bytes, vocabulary: bytes, sizes) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.asarray(sizes, np.int64)
    return np.frombuffer(vocabulary, U)[_expand(codes)], sizes


def explode_grams(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """``(n, part, chunk, hashes, counts)``: a chunk's distinct n-grams (sorted) by the high bits of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                chunk, weight, sizes, codes, vocabulary = (b.column(i)[r].as_py() for i in range(5))
                words, sizes = _positions(codes, vocabulary, sizes)
                out = []
                for n, (own, there) in enumerate(_grams(words, sizes, order), 1):
                    names = own[there]
                    names.sort()
                    first = np.flatnonzero(np.diff(names, prepend=~names[:1]))
                    counts = np.diff(first, append=len(names))
                    names = names[first]
                    part = (names >> U(HASH_BITS - bits)).astype(np.int64)
                    edges = np.flatnonzero(np.diff(part, prepend=-1, append=1 << bits))
                    for a, z in zip(edges[:-1], edges[1:]):
                        gaps = np.diff(names[a:z], prepend=U(0))
                        out.append((n, int(part[a]), chunk, _squeeze(gaps), _squeeze(counts[a:z] * weight)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.string(), pa.binary(),
                                                                    pa.binary()))],
                        ["n", "part", "chunk", "hashes", "counts"])
                    pa.default_memory_pool().release_unused()

    return chunks.select("chunk", "weight", "sizes", "codes", "vocabulary").mapInArrow(
        run, "n int, part int, chunk string, hashes binary, counts binary")


def count_and_answer(grams: DataFrame, min_count: int) -> DataFrame:
    """``(chunk, n, part, counts)``: the corpus counts of the chunk's n-grams, in their order (0: cut)."""

    def run(group: pa.Table) -> pa.Table:
        names = [np.cumsum(_expand(x), dtype=U) for x in group.column("hashes").to_pylist()]
        counts = [_expand(x) for x in group.column("counts").to_pylist()]
        table, at = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(table)).astype(np.int64)
        if group.column("n")[0].as_py() > 1:
            total[total < min_count] = 0
        found = np.split(total[at], np.cumsum([len(x) for x in names])[:-1])
        return pa.table({"chunk": group.column("chunk"), "n": group.column("n"), "part": group.column("part"),
                         "counts": pa.array([_squeeze(x) for x in found], pa.binary())})

    return grams.groupBy("n", "part").applyInArrow(run, "chunk string, n int, part int, counts binary")


def score_words(counts: list[np.ndarray], there: list[np.ndarray], total: int, backoff: float) -> np.ndarray:
    """log S of every word from the counts of the n-grams that end at it (order 1 first) and at the word before."""
    log = np.log(np.maximum(counts[0], 1) / max(1, total))
    for n in range(1, len(counts)):
        context = np.concatenate([[1], counts[n - 1][:-1]])
        hit = there[n] & (counts[n] > 0)
        # a word whose document has no such context stays with the shorter one, without a penalty
        log = np.where(hit, np.log(np.maximum(counts[n], 1) / np.maximum(context, 1)),
                       np.where(there[n], log + np.log(backoff), log))
    return log


def stupid_backoff(docs: DataFrame, corpus: DataFrame | None = None, order: int = 3, min_count: int = 2,
                   backoff: float = 0.4, chunk_bytes: int = 1 << 22, group_words: int = 1 << 20) -> DataFrame:
    """``(doc_id, n_words, log_score)`` of every row of ``docs``, with the counts of ``corpus`` (default: ``docs``)."""
    spark = docs.sparkSession
    chunks = layout(docs, 1 if corpus is None else 0, chunk_bytes)
    if corpus is not None:
        chunks = chunks.unionByName(layout(corpus, 1, chunk_bytes))
    name = table_name("lm_chunks")
    # a row holds megabytes: small row groups without dictionaries keep few of them in the writer
    (chunks.write.format("parquet").option("compression", "zstd").option("parquet.enable.dictionary", "false")
     .option("parquet.block.size", str(8 << 20)).bucketBy(shuffle_width(spark), "chunk").saveAsTable(name))
    laid = spark.table(name)
    words, total = laid.agg(F.sum("words"), F.sum(F.col("words") * F.col("weight"))).first()
    words, total = words or 0, total or 0
    bits = max(3, (words // group_words).bit_length())
    answers = (count_and_answer(explode_grams(laid, order, bits), min_count).groupBy("chunk")
               .agg(F.collect_list(F.struct("n", "part", "counts")).alias("answers")))
    own = laid if corpus is None else laid.filter("weight = 0")
    joined = own.join(answers, "chunk", "left").select("docs", "sizes", "codes", "vocabulary", "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, raw, codes, vocabulary, answers = (b.column(i)[r].as_py() for i in range(5))
                words, sizes = _positions(codes, vocabulary, raw)
                got: dict[int, list] = {}
                for a in sorted(answers or (), key=lambda a: (a["n"], a["part"])):
                    got.setdefault(a["n"], []).append(_expand(a["counts"]))
                counts, there = [], []
                for n, (own, has) in enumerate(_grams(words, sizes, order), 1):
                    each = np.zeros(len(words), np.int64)
                    if n in got:
                        each[has] = np.concatenate(got[n])[np.unique(own[has], return_inverse=True)[1]]
                    counts.append(each)
                    there.append(has)
                log = score_words(counts, there, total, backoff)
                sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=log, minlength=len(sizes))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums.astype(float))],
                                                 ["doc_id", "n_words", "log_score"])

    return joined.mapInArrow(run, "doc_id long, n_words long, log_score double")
