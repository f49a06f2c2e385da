"""Language ID with language-bitmask n-gram filters.

Each language's most frequent letter n-grams go into a Bloom filter of its
own; the filters are bit-sliced, so slot s holds one bit per language, and the
AND of an n-gram's slots is the mask of all languages that contain it.  A
text's languages are compared by their popcounts over all its n-grams, each
corrected for the filter's false-positive rate.

Learning reads a bounded sample of labelled documents per language
(``train_docs``, chosen by a hash of doc_id); prediction reads whole texts in
one pass without a shuffle.  The filter has a fixed size.

Defined results: NULL texts and texts without a letter are ``und`` with score
0; equal counts go to the language with more training documents, then by
name; a text without a known n-gram gets the first of these with score
1 / languages; repeated rows are reported each; no labelled document at all:
every row is ``und``; an empty table gives no rows.

A text is known (``identify(..., known=True)``) if some language holds more of
its n-grams than its filter's false positives explain.  Texts with letters but
fewer than ``LEAST_GRAMS`` n-grams, or where nothing could be learned, cannot be
judged and count as known; texts without a letter never do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tremorlake.llm.common import slices

UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER: np.ndarray | None = None
#: characters worked on at a time
SLAB = 1 << 19
#: n-grams a text needs to be held unknown: one of a learned language has a known one among so many
LEAST_GRAMS = 8


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def _collapse(text: str) -> str:
    """Runs of characters that are no letters as one blank each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    return np.where(letter, codes, 32)[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def gram_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts' letters (other runs are one blank), each one's text, and texts with letters."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), lens)
    letter = _letters()[codes]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    codes = np.where(letter, codes, 32).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    m = max(0, len(codes) - n + 1)
    whole = owner[:m] == owner[n - 1:n - 1 + m]
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h ^ codes[k:k + m]) * _MIX
        h ^= h >> np.uint64(29)
    return h[whole], owner[:m][whole], has


def _slabs(texts: list[str], n: int) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about SLAB characters; a longer one is cut into pieces that overlap by n - 1."""
    at, held, size = [], [], 0
    for i, t in enumerate(texts):
        t = f" {t.lower()} "
        if len(t) > SLAB:
            t = _collapse(t)  # a cut then parts single characters only
        for a in range(0, max(1, len(t) - n + 1), SLAB):
            piece = t[a:a + SLAB + n - 1]
            at.append(i)
            held.append(piece)
            size += len(piece)
            if size >= SLAB:
                yield at, held
                at, held, size = [], [], 0
    if held:
        yield at, held


@dataclass
class LanguageFilter:
    """``bits``: per slot a mask of languages (several words beyond 64 languages)."""

    languages: list[str]
    bits: np.ndarray
    n: int
    hashes: int

    def slots(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        mask = np.uint64(len(self.bits) - 1)
        for k in range(self.hashes):
            yield ((grams * np.uint64(2 * k + 1) * _MIX) >> np.uint64(24)) & mask

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """All languages whose filter holds each n-gram."""
        found = None
        for s in self.slots(grams):
            found = self.bits[s] if found is None else found & self.bits[s]
        return found

    def false_rate(self) -> np.ndarray:
        return np.array([np.mean(self.bits[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)) ** self.hashes
                         for i in range(len(self.languages))])

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether the text is known."""
        size = len(self.languages)
        counts, total = np.zeros((len(texts), size)), np.zeros(len(texts))
        has = np.zeros(len(texts), bool)
        for at, pieces in _slabs([t or "" for t in texts], self.n):
            grams, owner, letters = gram_hashes(pieces, self.n)
            rows = np.array(at)
            has[rows[letters]] = True
            np.add.at(total, rows, np.bincount(owner, minlength=len(at)))
            masks = self.masks(grams)
            for i in range(size):
                bit = masks[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)
                np.add.at(counts[:, i], rows, np.bincount(owner, weights=bit, minlength=len(at)))
        rate = self.false_rate()
        chance = total[:, None] * rate
        found = (counts > chance + 3 * np.sqrt(chance * (1 - rate))).any(axis=1)  # three sigma over the false ones
        judged = has & (found | (total < LEAST_GRAMS) if size else True)
        counts = np.maximum(0.0, counts - total[:, None] * rate) / np.maximum(1e-9, 1 - rate)
        best = counts.argmax(axis=1) if size else np.zeros(len(texts), int)
        top, sums = counts.max(axis=1, initial=0.0), counts.sum(axis=1)
        score = np.where(sums > 0, top / np.where(sums > 0, sums, 1), 1 / max(1, size))
        known = has & bool(size)
        return ([self.languages[b] if k else UNKNOWN for b, k in zip(best, known)],
                [float(s) if k else 0.0 for s, k in zip(score, known)], judged.tolist())

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]


def learn(docs: DataFrame, n: int = 4, train_docs: int = 4_000, grams: int = 4_000, slots: int = 1 << 17,
          hashes: int = 2) -> LanguageFilter:
    """Filter from ``docs(doc_id, text, lang)``: the ``grams`` most frequent n-grams of each language.

    ``train_docs`` bounds the sample: about so many documents per language,
    taken by a hash of doc_id at a rate that follows from the language's count.
    """
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    bits = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
    if not languages:
        return LanguageFilter([], bits, n, hashes)
    rate = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, train_docs / v))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter(draw < F.try_element_at(rate, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for _, pieces in _slabs([t for x, t in zip(langs, texts) if x == lang], n):
                    g, c = np.unique(gram_hashes(pieces, n)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    ranked = (sample.mapInArrow(count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
              .filter(F.col("rank") <= grams).select("lang", "gram").collect())
    out = LanguageFilter(languages, bits, n, hashes)
    for i, lang in enumerate(languages):
        own = np.array([r.gram for r in ranked if r.lang == lang], np.int64).view(np.uint64)
        for s in out.slots(own):
            bits[s, i >> 6] |= np.uint64(1) << np.uint64(i & 63)
    return out


def identify(docs: DataFrame, model: LanguageFilter, keep: list[str], known: bool = False,
             text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` plus ``lang_pred`` and ``score``, and ``known`` if asked for.

    The new columns replace columns of these names.  ``text`` names the column
    of the texts; if it is kept, the texts travel to the workers once.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score") + ("known",) * known]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text) if text in keep and docs.schema[text].dataType == StringType() else len(keep)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep],
                         *[F.col(f"`{text}`").cast("string").alias("__llm_text")] * (at == len(keep)))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("lang_pred", "string").add("score", "double")
    if known:
        schema = schema.add("known", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches):
            lang, score, judged = own.judge(b.column(at).to_pylist())
            extra = [pa.array(judged, pa.bool_())] if known else []
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64()), *extra], schema.fieldNames())

    return chosen.mapInArrow(run, schema)
