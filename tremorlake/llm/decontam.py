"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Training words stream through the automaton of all items; after each word the
length of the longest suffix that occurs in any item is known.  Where it
reaches ``window`` words, the whole match is a hit; items of fewer words are
one window of their own length.  Hit spans are reported, and can be cut from
the text.

The items are the stated query set: they are read in blocks of bounded size
(``block_words``), one automaton and one pass over the documents per block,
so what a task holds does not grow with the benchmark.  With one block no
document leaves its task.

Defined results: NULL or wordless texts have no words and no hits; items
without words, id or text are ignored; rows of ``items`` that repeat an item_id are one
item; repeated documents are reported each; an empty benchmark hits nothing;
an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake.llm.common import slices, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32)
                  for c in range(256))
SPANS = "array<struct<start:int,end:int>>"


def split_words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters (A-Z lower-cased) and characters beyond ASCII, of UTF-8 bytes."""
    return (text or b"").translate(_TO_WORDS).split()


class ItemAutomaton:
    """Suffix automaton of many word sequences, with the items of each window at its states."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if seq:
                coded.append((item, seq))
                last = 0
                for c in seq:
                    last = self._extend(last, c)
        self.windows: dict[int, set] = {}  # state -> items with that window
        self.short: dict[int, list] = {}  # state -> (length, item) of whole short items
        for item, seq in coded:
            v = 0
            for i, c in enumerate(seq):
                v = self.next[v][c]
                while self.length[self.link[v]] >= window:
                    v = self.link[v]
                if i + 1 >= window:
                    self.windows.setdefault(v, set()).add(item)
            if len(seq) < window:
                self.short.setdefault(v, []).append((len(seq), item))
        self.least = min([window, *(n for e in self.short.values() for n, _ in e)])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        """A copy of state q for the shorter strings that arrive from p."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal hit spans (word positions, end exclusive) and the items whose windows occur."""
        nxt, link, length, window, least = self.next, self.link, self.length, self.window, self.least
        spans: list[tuple[int, int]] = []
        items: set = set()
        v = size = 0
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                v = size = 0
                continue
            while c not in nxt[v]:
                v = link[v]
                size = length[v]
            v = nxt[v][c]
            size += 1
            if size >= least:
                hit = self._hits(v, size, items)
                if hit:
                    start = i + 1 - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items

    def _hits(self, v: int, size: int, items: set) -> int:
        """Length of the longest hit that ends here; adds the items of its windows."""
        hit = size if size >= self.window else 0
        while v > 0:
            for n, item in self.short.get(v, ()):
                if n <= size:
                    items.add(item)
                    hit = max(hit, n)
            if self.length[self.link[v]] < self.window <= size and v in self.windows:
                items |= self.windows[v]
            v = self.link[v]
        return hit


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from each span's first word to its last."""
    at = [m.span() for m in WORD.finditer(text.lower())]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done:at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items in blocks of about ``block_words`` words, one block on the driver at a time."""
    raw = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").alias("item"), F.col("text").cast("binary").alias("text"))
    total = raw.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // (block_words * 6)))
    for b in range(count):
        block = raw if count == 1 else raw.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == b)
        yield [(r.item, split_words(bytes(r.text))) for r in block.toLocalIterator()]


def _scan(docs: DataFrame, automaton: ItemAutomaton, keep: list[str], only_hits: bool, cut: bool) -> DataFrame:
    """One pass: columns ``keep`` of ``docs``, then n_words, spans, items (and the text without its spans)."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(automaton))
    fields = [f for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields]
    schema = T.StructType(fields)
    for name, kind in (("__llm_words", "long"), ("__llm_spans", SPANS), ("__llm_items", "array<string>"),
                       *([("__llm_cut", "binary")] if cut else [])):
        schema = schema.add(name, T.DataType.fromDDL(kind))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = pickle.loads(shared.value)
        for b in slices(batches):
            texts = b.column(b.num_columns - 1)
            words, spans, items, cuts = [], [], [], []
            for t in texts:
                t = t.as_py()
                ws = split_words(t)
                hit, found = auto.scan(ws)
                words.append(len(ws))
                spans.append([{"start": x, "end": y} for x, y in hit])
                items.append(sorted(map(str, found)))
                if cut:
                    cuts.append(_cut(t, hit) if hit else None)
            cols = [*b.columns[:-1], pa.array(words, pa.int64()), pa.array(spans, span),
                    pa.array(items, pa.list_(pa.string())), *([pa.array(cuts, pa.binary())] if cut else [])]
            out = pa.RecordBatch.from_arrays(cols, schema.fieldNames())
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if only_hits else out

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("binary").alias("__llm_text"))
    return chosen.mapInArrow(run, schema)


def _merge_spans(spans):
    """Union of the blocks' spans: sorted, overlapping or touching ones joined."""
    empty = F.lit(None).cast(SPANS)
    return F.aggregate(
        F.array_sort(spans), F.coalesce(empty, F.array().cast(SPANS)),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"),
                F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 100_000) -> DataFrame:
    """``(doc_id, n_words, spans, items)`` per document: hit spans of words, and the ids (as text) of items that hit."""
    out = None
    blocks = _blocks(items, block_words)
    first = ItemAutomaton(next(blocks), window)
    names = {"__llm_words": "n_words", "__llm_spans": "spans", "__llm_items": "items"}
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for n, block in enumerate(blocks):
        if n == 0:  # several blocks: rows need a name that each pass gives them again
            narrow = written(narrow.withColumn("row", F.monotonically_increasing_id()), "decontam-docs")
            out = _scan(narrow, first, ["row", "doc_id"], False, False)
        out = out.unionByName(_scan(narrow, ItemAutomaton(block, window), ["row", "doc_id"], True, False))
    if out is None:
        return _scan(narrow, first, ["doc_id"], False, False).withColumnsRenamed(names)
    return (out.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("__llm_words").alias("n_words"),
        _merge_spans(F.flatten(F.collect_list("__llm_spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("__llm_items"))).alias("items")).drop("row"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5,
                  block_words: int = 100_000) -> DataFrame:
    """``docs`` (all columns) with every hit span cut from ``text``.

    A document whose hit words exceed ``max_coverage`` of its words is a copy
    of the benchmark and goes as a whole.  Each block of items is one pass
    over what the previous one left; spans are judged on the given texts, so
    with several blocks the first pass marks and the cuts are made together.
    """
    blocks = _blocks(items, block_words)
    first = next(blocks)
    more = next(blocks, None)
    hit_words = F.aggregate("__llm_spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    if more is None:
        marked = _scan(docs, ItemAutomaton(first, window), docs.columns, False, True)
        text = F.coalesce(F.col("__llm_cut").cast("string"), F.col("text"))
    else:
        rows = written(docs.withColumn("__llm_row", F.monotonically_increasing_id()), "decontam-docs")
        found = contamination(rows.select(F.col("__llm_row").alias("doc_id"), "text"), items, window, block_words)
        found = found.select(F.col("doc_id").alias("__llm_row"), F.col("n_words").alias("__llm_words"),
                             F.col("spans").alias("__llm_spans"))
        marked = rows.join(found, "__llm_row")

        @F.udf("string")
        def text_without(text, spans):
            return _cut(text.encode(), [(s.start, s.end) for s in spans]).decode() if spans else text

        text = text_without("text", "__llm_spans")
    kept = marked.filter(hit_words <= F.col("__llm_words") * max_coverage)
    return kept.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
