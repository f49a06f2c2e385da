import itertools
import random
import zlib

import numpy as np
import pytest
from llm_cases import documents, empty, frame

from tremorlake.llm import packing, queries, sharding


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    return lambda text: [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def test_best_fill_equals_exhaustive_search():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(0, 70)
        fill = packing.best_fill(counts, sorted(counts), room)
        assert all(0 < c <= counts[n] for n, c in fill.items())
        choices = [[n * k for k in range(c + 1)] for n, c in counts.items()]
        best = max(s for s in map(sum, itertools.product(*choices)) if s <= room)
        assert sum(n * c for n, c in fill.items()) == best


@pytest.mark.parametrize("text", [
    "It's the dog's; they'll've re'd 'S 12³½ a_b", "ÀÉÎ Straße ŉ ﬁne", "ΑΣ ΣΑΣ", "İstanbul I", "日本語 text", "<|endoftext|> a",
    "é x y z", "'ss 'tt ''re", "", " \n\t ", "\x1c\x85a", "ǅ ǆ Ǆ",
])
def test_word_cache_gives_the_tokenizers_ids(text, reference_ids):
    got = packing.tokenizer(packing.tokenizer_path()).encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == reference_ids(text)[:-1]


def test_word_cache_is_bounded_by_bytes(reference_ids):
    rng = random.Random(8)
    tok = packing.WordTokenizer(packing.tokenizer_path(), cache_bytes=1 << 16)
    every = [chr(c) for c in [*range(32, 127), *range(0xA1, 0x130), *range(0x131, 0x250)]]
    latin = [c for c in every if c.lower() <= "\u024f"]
    most = 0
    for _ in range(40):
        texts = ["".join(rng.choices(latin, k=300)) + f" the of {rng.random()} it's" for _ in range(8)]
        texts = [t.replace("<|", "< |") for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == [reference_ids(t)[:-1] for t in texts]
        most = max(most, *(sum(200 + len(w) + len(ids) for w, ids in c.items()) for c in (tok.cache, tok.older)))
    assert tok.older and most < 1 << 18  # half the bound and the words of one call; all words: over 3 MB
    assert "the" in tok.cache
    words = [w for _ in range(40) for w in tok.split("".join(rng.choices(every, k=300)).lower())]
    assert tok._pack_words(words) == tok._pack(words)


class Counted(dict):
    """A dictionary that counts what it is asked for."""

    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_each_different_word_is_looked_up_once(reference_ids):
    tok = packing.WordTokenizer(packing.tokenizer_path())
    tok.cache = Counted()
    texts = ["It's the dog's, of 12 the cats. " * 100] * 5
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == [reference_ids(t)[:-1] for t in texts]
    assert tok.cache.asked <= 40  # of 6,500 words; with a second look at the new ones


def test_texts_cut_together_keep_their_own_ids(reference_ids, monkeypatch):
    rng = random.Random(5)
    parts = ["'s", "'T", "'re", "'VE", "'l", "'ll", "'", "''", "s", "e", "d", "Ve", "12", "½", " ", "\n", "-", "É", "¡",
             "Ɠ", "Ɲ", "Ⱥ", "the ", "'dd 'm"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)] + ["", "日本's", "x'", "s"]
    want = [reference_ids(t)[:-1] for t in texts]
    for chars in (1, 100, 1 << 20):
        monkeypatch.setattr(packing, "GROUP_CHARS", chars)
        tok = packing.WordTokenizer(packing.tokenizer_path())
        assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == want
    assert tok.encode([]) == [] and tok.encode([""]) == tok.encode([" \n"]) == [b""]
    assert tok.split("It's 12 a-b'll".lower()) == ["it", "'s", "1", "2", "a", "-", "b", "'ll"]


def check_pieces(rows, ids, capacity):
    covered = {}
    for r in rows:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert np.frombuffer(r.ids, "<u4").tolist() == piece and r.doc_tokens == len(ids[r.doc_id])
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, own in ids.items():
        at = 0
        for start, length in sorted(covered[doc]):
            assert start == at and length > 0
            at += length
        assert at == len(own)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    fills = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        fills.append(at)
    return fills


def test_pieces_cover_every_document_once(spark, reference_ids):
    df, texts = documents(spark)
    rows = packing.pack(df, packing.tokenizer_path(), capacity=128, buffer_tokens=3000).collect()
    fills = check_pieces(rows, {d: reference_ids(t) for d, t in texts.items()}, 128)
    assert sum(128 - f > 8 for f in fills) <= 3  # one short window a task


def test_equal_lengths_are_cut_to_fill(spark, reference_ids):
    df = frame(spark, [(i, "alpha beta " * 20) for i in range(90)]).coalesce(1)
    ids = {i: reference_ids("alpha beta " * 20) for i in range(90)}
    rows = packing.pack(df, packing.tokenizer_path(), capacity=64).collect()
    fills = check_pieces(rows, ids, 64)
    assert sum(64 - f > 8 for f in fills) <= 1


def test_pack_repeated_rows_and_empty(spark):
    df = frame(spark, [(1, "a b"), (1, "a b"), (2, None)])
    rows = packing.pack(df, packing.tokenizer_path()).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == [(1, 3), (1, 3), (2, 1)]
    assert packing.pack(empty(spark), packing.tokenizer_path()).collect() == []


def check_shards(rows, texts, shards, tolerance):
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes, slots, home = [0] * shards, [[] for _ in range(shards)], {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert home.setdefault(raw, r.shard) == r.shard
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sizes


def test_shards_are_even_and_whole(spark):
    rng = random.Random(2)
    texts = {i: "w" * rng.randrange(0, 400) + str(i) for i in range(3000)}
    texts |= {i: "copy" * 50 for i in range(3000, 3300)} | {3300: None, 3301: ""}
    rows = sharding.shard(frame(spark, list(texts.items())), rows_per_bin=20).collect()
    sizes = check_shards(rows, texts, 8, 0.02)
    assert max(sizes) / (sum(sizes) / 8) < 1.02 and min(sizes) / (sum(sizes) / 8) > 0.98


def test_shards_with_a_hot_text_over_one_share(spark):
    texts = {i: "copy" * 50 for i in range(500)} | {i: f"text {i} " * 5 for i in range(500, 1500)}
    sizes = check_shards(sharding.shard(frame(spark, list(texts.items()))).collect(), texts, 8, 1)
    rest = sorted(sizes)[:-1]
    assert max(sizes) >= 500 * 201 and max(rest) / min(rest) < 1.2


def test_shard_edges(spark):
    df, texts = documents(spark)
    check_shards(sharding.shard(df).collect(), texts, 8, 1)
    assert sharding.shard(empty(spark)).collect() == []
    rows = sharding.shard(frame(spark, [(1, "a"), (1, "a"), (None, "b")])).collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == [(0, 2), (1, 2), (1, 2)]


def test_written_shards_hold_all_columns(spark, tmp_path):
    df, texts = documents(spark)
    sharding.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id: r.text for r in back.collect()} == texts
    want = {r.doc_id: r.shard for r in sharding.shard(df).collect()}
    assert {r.doc_id: r.shard_folder for r in back.collect()} == want


@pytest.mark.parametrize("ids", [list(range(1500)), [None] * 500 + list(range(1000)), [7] * 500 + list(range(1000))])
def test_query_cuts_a_hot_text_into_even_shards(spark, tmp_path, ids):
    texts = ["copy" * 50] * 500 + [f"text {i} " * 5 for i in range(1000)]
    frame(spark, list(zip(ids, texts))).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op3_histogram_shards(spark, str(tmp_path)).collect()
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    raw = [t.encode() for t in texts]
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i or 0, len(b) + 1, zlib.crc32(b)) for i, b in zip(ids, raw))
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 3 * 201  # a splitter is off by half a row at most, and 0.1 %


def test_many_rows_without_bytes_are_dealt_over_bins(spark):
    df = frame(spark, [(None, "") for _ in range(1500)] + [(i, f"text {i}") for i in range(3000)])
    rows = sharding.written(sharding.keyed(df), "shard-test")
    placed = sharding.ShardPlan(rows, 8, 0.001, whole_texts=False).place(rows, rows_per_bin=50)
    assert placed.groupBy("shard", "bin").count().agg({"count": "max"}).first()[0] <= 150


def test_written_shards_of_a_hot_text_are_even(spark, tmp_path):
    texts = {i: "copy" * 50 for i in range(500)} | {i: f"text {i} " * 5 for i in range(500, 1500)}
    sharding.write_shards(frame(spark, list(texts.items())), str(tmp_path / "out"), whole_texts=False)
    sizes = [0] * 8
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        assert texts.pop(r.doc_id) == r.text
        sizes[r.shard_folder] += len(r.text) + 1
    assert not texts and max(sizes) - min(sizes) <= 3 * 201
