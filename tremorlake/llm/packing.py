"""Packing: documents into training sequences by minimum bin slack.

A task tokenises its documents, cuts each into full windows and one rest, and
packs the rests of a bounded buffer: the longest rest opens a window, a bitset
subset-sum over the multiset of remaining lengths finds the fill closest to
the capacity, and backtracking through the bitsets gives the count of each
length.  The found multiset is repeated while its counts last.  Where even the
closest fill leaves more than ``max_slack`` tokens, the next rest is cut to
fill it.  A window that is still open when the buffer is empty waits for the
next buffer, so a task leaves at most one short window.

No row leaves its task: packing needs no shuffle, no driver state and memory
for one buffer of tokens; a lost task is simply run again.

Defined results: a NULL or empty text is the end token alone; every row,
repeated or not, is packed; other columns are never read; an empty table
gives no rows.  Sequence ids are unique (task number and a counter), not
consecutive.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import slices

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Latin text: here lower-casing and composition act per character, and the classes below are stable.
_PLAIN = re.compile("[\\t\\n\\r -~¡-įı-ɏ]*\\Z")

#: a cached word beside its letters and ids: two object heads and its place in the dictionary
ENTRY_BYTES = 200
#: Latin texts are cut into words together up to so many characters (or one text)
GROUP_CHARS = 1 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case form (of the Latin ones) and class of every 16-bit character: 0 blank, 1 letter, 2 number, 3 sign."""
    import unicodedata

    chars = [chr(c) for c in range(1 << 16)]
    lower = np.arange(1 << 16, dtype="<u2")
    lower[:0x250] = [ord(c.lower()[0]) for c in chars[:0x250]]
    kind = np.array([{"L": 1, "N": 2}.get(unicodedata.category(c)[0], 3) for c in chars], np.uint8)
    kind[[ord(c) for c in "\t\n\r "]] = 0
    return lower, kind


class WordTokenizer:
    """Token ids of whole texts as little-endian 32-bit bytes, with a cache of recent words.

    ``word_bpe_49k.json`` splits a lower-cased text into words, digits and
    runs of signs and encodes each alone, so texts of Latin characters are
    cut into words together, as arrays; each different word of theirs is
    looked up in the cache or encoded once.  Any other text goes to the
    tokenizer whole.  The cache outlives a task, as its worker process does,
    so its memory is bounded: at half of ``cache_bytes`` the words of late
    become the older ones and the older ones go; a word met again is of late.
    """

    def __init__(self, path: str, cache_bytes: int = 64 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.cut = Tokenizer(self.whole.model)  # for words that are cut and lower-cased already
        self.cut.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.cut.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_bytes = cache_bytes
        self.held = 0  # bytes of the cache without the older words
        self.lower, self.kind = _characters()

    def _pack(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _pack_words(self, words: list[str]) -> list[bytes]:
        """As ``_pack``, many lower-case words a call: the tokenizer parts them at the blanks."""
        out: list[bytes] = []
        for a in range(0, len(words), 512):
            own = words[a:a + 512]
            e, = self.cut.encode_batch_fast([" ".join(own)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            ids = ids.tobytes()
            out += ([ids[i:j] for i, j in zip([0, *cuts], cuts)] if len(cuts) == len(own) and cuts[-1] == len(ids)
                    else self._pack(own))
        return out

    def _words(self, text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Place of every word of a text, its number, and the different words by number."""
        chars = self.lower[np.frombuffer((text + "\n\n").encode("utf-16-le", "surrogatepass"), "<u2")]
        kind = self.kind[chars]
        begins = np.ones(len(chars), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        # 's 't 're 've 'm 'll 'd: a quote that begins a word takes these letters, and another word begins after them
        quotes = np.flatnonzero(chars == ord("'"))
        quotes = quotes[begins[quotes]]
        one, two = chars[quotes + 1], chars[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[quotes[short | long] + 1] = False
        begins[quotes[short] + 2] = begins[quotes[long] + 3] = True
        full = kind > 0
        begins &= full
        chars = chars[full]
        bounds = 2 * np.append(np.flatnonzero(begins[full]), len(chars))
        words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                      [None, pa.py_buffer(bounds), pa.py_buffer(chars)]).dictionary_encode()
        # the different words are sliced from one string: a value at a time is slow
        bounds = np.frombuffer(words.dictionary.buffers()[1], np.int64)[:len(words.dictionary) + 1].tolist()
        every = words.dictionary.buffers()[2].to_pybytes()[:bounds[-1]].decode("utf-16-le", "surrogatepass")
        return (np.flatnonzero(begins), words.indices.to_numpy(),
                [every[a // 2:b // 2] for a, b in zip(bounds, bounds[1:])])

    def split(self, text: str) -> list[str]:
        _, number, words = self._words(text)
        return [words[i] for i in number]

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Ids of different words, by the cache."""
        if self.held > self.cache_bytes // 2:
            self.cache, self.older, self.held = {}, self.cache, 0
        own = list(map(self.cache.get, words))
        missing = [i for i, ids in enumerate(own) if ids is None]
        for i in missing:
            own[i] = self.older.get(words[i])
        new = [i for i in missing if own[i] is None]
        for i, ids in zip(new, self._pack_words([words[i] for i in new])):
            own[i] = ids
        self.cache.update((words[i], own[i]) for i in missing)
        self.held += sum(ENTRY_BYTES + len(words[i]) + len(own[i]) for i in missing)
        return own

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of Latin texts: those of their different words, laid out in the order of the words."""
        place, number, words = self._words("\n".join(texts))
        own = self._look_up(words)
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        before = np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(size[number])])
        ids = np.arange(ends[-1]) + np.repeat(before[number] - ends[:-1], size[number])
        ids = np.frombuffer(b"".join(own), "<u4")[ids].tobytes()
        cuts = (4 * ends[np.searchsorted(place, np.cumsum([len(t) + 1 for t in texts]))]).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if _PLAIN.match(t) and "<|" not in t]
        group, size = [], 0
        for at, i in enumerate(plain, 1):
            group.append(i)
            size += len(texts[i])
            if size >= GROUP_CHARS or at == len(plain):
                for k, ids in zip(group, self._encode_plain([texts[k] for k in group])):
                    out[k] = ids
                group, size = [], 0
        other = sorted(set(range(len(texts))).difference(plain))
        for k, ids in zip(other, self._pack([texts[k] for k in other])):
            out[k] = ids
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer (and word cache) per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """Multiset of lengths (at most ``counts`` of each) whose sum is the largest one not over ``room``.

    ``lengths`` is sorted; the longest come first.  Bit s of a bitset says
    that sum s can be made; a length with count c is added in powers of two,
    so every step is one shift.  The steps are walked back to read off the
    counts.
    """
    mask, steps, reach = (1 << room + 1) - 1, [], 1
    for at in range(bisect.bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[at]
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & mask
            left -= k
            k *= 2
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            taken[length] += k
    return dict(taken)


class Packer:
    """Windows of ``capacity`` filled from buffered rests; ``place(item, cut, size, sequence, offset)`` per piece."""

    def __init__(self, capacity: int, max_slack: int, first_sequence: int, place):
        self.capacity, self.max_slack, self.place = capacity, max_slack, place
        self.next = first_sequence
        self.rests: dict[int, list] = defaultdict(list)  # length -> [(item, cut)]
        self.open: tuple[int, int] | None = None  # sequence and fill of the window that waits

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, item, length: int) -> None:
        """Cut the full windows off at once; the rest waits."""
        full = length // self.capacity * self.capacity
        for cut in range(0, full, self.capacity):
            self.place(item, cut, self.capacity, self.new(), 0)
        if length > full:
            self.rests[length - full].append((item, full))

    def flush(self) -> None:
        """Pack all waiting rests; the last window may stay open."""
        rests = self.rests
        self.lengths = sorted(rests)
        counts = self.counts = {n: len(v) for n, v in rests.items()}
        while self.lengths:
            if self.open:
                (sequence, fill), self.open, times = self.open, None, 1
                chosen = best_fill(counts, self.lengths, self.capacity - fill)
            else:
                sequence, fill, first = self.new(), 0, self.lengths[-1]
                counts[first] -= 1
                chosen = best_fill(counts, self.lengths, self.capacity - first)
                counts[first] += 1
                chosen[first] = chosen.get(first, 0) + 1
                times = min(counts[n] // c for n, c in chosen.items())
            slack = self.capacity - fill - sum(n * c for n, c in chosen.items())
            if slack > self.max_slack:
                times = 1
            for again in range(times):
                if again:
                    sequence, fill = self.new(), 0
                for n in sorted(chosen, reverse=True):
                    for _ in range(chosen[n]):
                        fill = self._take(n, sequence, fill)
            if slack > self.max_slack:
                if self.lengths:
                    fill = self._cut(self.lengths[-1], sequence, fill)
                if fill < self.capacity:
                    self.open = (sequence, fill)
        self.rests = defaultdict(list)

    def _pop(self, length: int):
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.lengths[bisect.bisect_left(self.lengths, length)]
        return self.rests[length].pop()

    def _take(self, length: int, sequence: int, fill: int) -> int:
        item, cut = self._pop(length)
        self.place(item, cut, length, sequence, fill)
        return fill + length

    def _cut(self, length: int, sequence: int, fill: int) -> int:
        """Fill the window with the head of a rest; its tail waits again."""
        item, cut = self._pop(length)
        head = min(length, self.capacity - fill)
        self.place(item, cut, head, sequence, fill)
        if length > head:
            tail = length - head
            if not self.counts.get(tail):
                bisect.insort(self.lengths, tail)
            self.counts[tail] = self.counts.get(tail, 0) + 1
            self.rests[tail].append((item, cut + head))
        return fill + head


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, max_slack: int = 8,
         buffer_tokens: int = 4_000_000) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)`` of all documents.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit
    bytes.  ``buffer_tokens`` bounds the tokens whose rests are packed
    together in a task.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        out: list[tuple] = []

        def place(item, cut, size, sequence, offset):
            doc, ids = item
            out.append((doc, cut, size, len(ids) // 4, sequence, offset, ids[4 * cut:4 * (cut + size)]))

        packer = Packer(capacity, max_slack, TaskContext.get().partitionId() << 36, place)

        def emit():
            rows, out[:] = list(out), []
            for i in range(0, len(rows), 4096):
                cols = zip(*rows[i:i + 4096])
                types = [pa.int64()] * 6 + [pa.binary()]
                names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        held = 0
        for batch in slices(batches, 256):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode(texts)):
                packer.add((doc, ids + end), len(ids) // 4 + 1)
                held += len(ids) // 4 + 1
            if held >= buffer_tokens:
                packer.flush()
                held = 0
            if len(out) >= 4096:
                yield from emit()
        packer.flush()
        yield from emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, SCHEMA)
