import hashlib
import random

import pytest
from llm_cases import documents, empty, frame
from pyspark.sql import functions as F

from tremorlake.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from tremorlake.llm.common import connected_components, lookup_skewed
from tremorlake.session import scratch_dir


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_exact(texts):
    groups = {}
    for d, t in texts.items():
        groups.setdefault(t or "", []).append(d)
    return {d: (max(g), len(g)) for g in groups.values() for d in g}


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_dedup_matches_brute_force(spark, batches):
    df, texts = documents(spark)
    rows = exact_dedup.exact_dedup(df, batches=batches).collect()
    want = brute_exact(texts)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == want and len(rows) == len(texts)
    for r in rows:
        assert bytes(r.digest) == hashlib.sha256((texts[r.doc_id] or "").encode()).digest()
        assert r.kept == (r.doc_id == r.keep_id)


def test_digest_index_persists_and_keeps_first_entries(spark):
    path = scratch_dir(spark, "index-test")
    first = exact_dedup.DigestIndex(spark, path, buckets=4)
    exact_dedup.exact_dedup(frame(spark, [(1, "a"), (2, "b"), (3, "a")]), first)
    again = exact_dedup.DigestIndex(spark, path, buckets=4)  # a later session opens the same folder
    rows = exact_dedup.exact_dedup(frame(spark, [(10, "a"), (11, "c"), (12, "c")]), again).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in rows} == {10: (3, False), 11: (12, False), 12: (12, True)}
    assert again.read().count() == 3
    kept = exact_dedup.deduplicate(frame(spark, [(20, "c"), (21, "d")]), again)
    assert [r.doc_id for r in kept.collect()] == [21]


def test_index_side_needs_no_exchange(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    batch = exact_dedup.digests(frame(spark, [(i, str(i)) for i in range(50)]))
    index.add(batch)
    plan = plans(batch.groupBy("digest").agg(F.max("doc_id").alias("k"))
                 .join(index.read().hint("merge"), "digest", "left_anti"))
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(empty(spark)).collect() == []
    rows = exact_dedup.exact_dedup(frame(spark, [(None, "a"), (5, "a"), (5, "a"), (None, "z"), (7, None), (8, "")]))
    got = sorted(((r.doc_id or -1), r.keep_id or -1, r.group_size, r.kept) for r in rows.collect())
    assert got == [(-1, -1, 1, True), (-1, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (7, 8, 2, False), (8, 8, 2, True)]


def brute_lines(texts, least=10):
    low = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    owner = {}
    for d in sorted(texts):
        for x in (texts[d] or "").split("\n"):
            owner.setdefault(key(x), d)
    out = {}
    for d, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or owner[key(x)] == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup_matches_brute_force(spark, batches, fanout):
    df, texts = documents(spark)
    rows = line_dedup.line_dedup(df, batches=batches, fanout=fanout).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in rows} == brute_lines(texts)
    assert len(rows) == len(texts) and rows[0].pos == "clash-pos"


def test_runs_are_levelled_and_disjoint(spark):
    store = line_dedup.RunStore(spark, fanout=2, buckets=2)
    for b in range(5):
        rows = [(b * 10 + i, f"shared line {i}\nown line number {b}-{i}") for i in range(4)]
        store.add(line_dedup.line_hashes(frame(spark, rows), 10))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    keys = [(r.h1, r.h2) for run in store.runs() for r in run.collect()]
    assert len(keys) == len(set(keys)) == 4 + 20


def test_line_dedup_edges(spark):
    assert line_dedup.line_dedup(empty(spark)).collect() == []
    rows = [(3, "a long line here\nshort"), (3, "a long line here\nother text"), (9, "A LONG LINE HERE \n\n"),
            (None, "a long line here"), (4, "a long line here\na long line here")]
    got = sorted((r.doc_id or -1, r.n_dropped, r.text) for r in line_dedup.line_dedup(frame(spark, rows)).collect())
    assert got == [(-1, 0, "a long line here"), (3, 0, "a long line here\nother text"), (3, 0, "a long line here\nshort"),
                   (4, 2, ""), (9, 1, "\n")]


def brute_fingerprint(text, shingle=4):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, linked):
    groups = {v: {v} for v in values}
    order = sorted(values)
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if groups[a] is not groups[b] and linked(a, b):
                groups[a] |= groups[b]
                for x in groups[b]:
                    groups[x] = groups[a]
    return groups


def test_fingerprints_and_components_match_brute_force(spark):
    df, texts = documents(spark)
    rows = simhash.near_duplicates(df).collect()
    want = {d: brute_fingerprint(t) for d, t in texts.items()}
    assert {r.doc_id: r.fp % (1 << 64) for r in rows} == want and len(rows) == len(texts)
    groups = brute_groups(set(want.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    assert {r.doc_id: r.component_id for r in rows} == {
        d: min(x for x, f in want.items() if f in groups[want[d]]) for d in texts}


def test_dense_fingerprints_are_linked_exactly(spark):
    """Chains and clouds of fingerprints a few bits apart, far denser than random ones."""
    rng = random.Random(11)
    values = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(120):
            values.add(x)
            for _ in range(rng.choice([1, 3, 4, 5, 6])):
                x ^= 1 << rng.randrange(64)
    values |= {0, (1 << 64) - 1, 0b1111, 0b11111}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = simhash.fingerprint_components(spark.createDataFrame(signed, "fp long")).collect()
    comp = {r.fp % (1 << 64): r.comp for r in got}
    groups = brute_groups(values, lambda a, b: (a ^ b).bit_count() <= 4)
    for a in values:
        assert {x for x in values if comp.get(x, ("alone", x)) == comp.get(a, ("alone", a))} == groups[a]


def test_cells_are_never_broadcast(spark, monkeypatch):
    """Spark sizes the cells of a few fingerprints too low: a side with a row per cell would go to the driver whole."""
    made, write = {}, simhash.written

    def seen(df, name):
        made[name] = plans(df)
        return write(df, name)

    monkeypatch.setattr(simhash, "written", seen)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    simhash.fingerprint_components(spark.createDataFrame([(i % 3,) for i in range(9)], "fp long").distinct()).collect()
    assert "Generate explode" in made["simhash-members"]
    assert "SortMergeJoin" in made["simhash-members"] and "Broadcast" not in made["simhash-members"]


def test_lookup_broadcasts_hot_keys_only(spark):
    rows = spark.createDataFrame([(1, i) for i in range(90)] + [(i, i) for i in range(2, 12)], "k long, i long")
    table = spark.createDataFrame([(1, 90, "hot")] + [(i, 1, "cold") for i in range(2, 12)], "k long, n long, what string")
    found = lookup_skewed(rows, table, ["k"], "n", 100, share=10)
    plan = plans(found)
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1
    assert sorted((r.k, r.i, r.what) for r in found.collect()) == \
        [(1, i, "hot") for i in range(90)] + [(i, i, "cold") for i in range(2, 12)]


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(4)
    rows = [(rng.getrandbits(63), rng.getrandbits(63) - (1 << 62)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, b long").select(
        "a", "b", F.bit_count(simhash.unary_counts(F.col("a")).bitwiseXOR(simhash.unary_counts(F.col("b")))).alias("m"),
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h"))
    for r in df.collect():
        counts = [abs((r.a >> i & 3).bit_count() - (r.b >> i & 3).bit_count()) for i in range(0, 64, 2)]
        assert r.m == sum(counts) <= r.h


def test_simhash_edges(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    rows = simhash.near_duplicates(frame(spark, [(None, "a b"), (4, "A  b"), (4, "a\tb"), (6, None), (5, "  ")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 4), (4, 4), (4, 4), (5, 5), (6, 5)]
    df, _ = documents(spark)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns


def test_one_row_of_a_group_stays_with_null_and_repeated_ids(spark):
    one, two, three = ("alpha beta gamma delta " * 6 + w for w in ("one", "two two two", "three three three three"))
    one, two, three = one, two[::-1], three.upper()[5:] + " omega" * 30
    rows = [(None, one), (None, one), (7, two), (None, two), (7, two), (7, three), (9, three), (None, None), (None, "")]
    df = frame(spark, rows)
    fps = {t: brute_fingerprint(t) for t in (one, two, three, "")}
    assert all((a ^ b).bit_count() > 4 for a in fps.values() for b in fps.values() if a != b)
    kept = sorted(((r.doc_id or 0, r.text or "") for r in simhash.drop_near_duplicates(df).collect()))
    assert kept == sorted([(0, one), (7, two), (7, three), (0, "")])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


def brute_suffix(texts, length):
    seen = {}
    raw = [(d, (t or "").encode()) for d, t in texts]
    for _, b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    out = []
    for d, b in raw:
        spans = []
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + length)
                else:
                    spans.append((i, i + length))
        edges = [0, *(e for s in spans for e in s), len(b)]
        out.append((d, len(b), spans, b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))))
    return sorted(out, key=repr)


def suffix_rows(df, **how):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept))
                   for r in suffix_dedup.suffix_dedup(df, **how).collect()), key=repr)


@pytest.mark.parametrize("length,gram", [(20, 8), (60, 16), (300, 64)])
def test_repeated_passages_match_brute_force(spark, length, gram):
    rng = random.Random(length)
    letters = "abcdefgh"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(length, 4 * length))) for _ in range(5)]
    rows = []
    for i in range(60):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 2 * length)))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += p[a:a + rng.randrange(1, len(p) + 1)] + rng.choice(["", "é", rng.choice(letters)])
        rows.append((i, t))
    rows += [(90, "ab" * length), (91, "z" * (length - 1)), (92, "z" * length), (93, "q" * (3 * length)), (94, None)]
    rows += [(95, passages[0]), (96, passages[0]), (97, ""), (97, "dup" * length), (97, "dup" * length), (None, passages[1])]
    assert suffix_rows(frame(spark, rows), length=length, gram=gram) == brute_suffix(rows, length)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    base = "".join(rng.choice("abc def") for _ in range(6000))
    rows = [(1, base), (2, base[3000:3500] + "!" + base[:200]), (3, base[:90] + base[91:])]
    texts = [t.encode() for _, t in rows]
    whole = [x for x in suffix_dedup._pieces(texts, 50)]
    monkeypatch.setattr(suffix_dedup, "SLAB", 700)
    pieces = [x for x in suffix_dedup._pieces(texts, 50)]
    windows = lambda ps: sorted((o, b + i) for os, bs, hs in ps
                                for o, b, h in zip(os, bs, hs) for i in range(max(0, len(h) - 49)))
    assert len(whole) == 1 < len(pieces) and windows(whole) == windows(pieces)


def test_suffix_edges(spark):
    assert suffix_dedup.suffix_dedup(empty(spark)).collect() == []
    df, texts = documents(spark)
    assert suffix_rows(df, length=100, gram=16) == brute_suffix(list(texts.items()), 100)


def test_a_digest_index_is_reopened_with_its_own_buckets(spark, tmp_path):
    from tremorlake.llm import exact_dedup

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    path, width = f"{tmp_path}/index", spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        exact_dedup.DigestIndex(spark, path).add(exact_dedup.digests(docs))
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        again = exact_dedup.DigestIndex(spark, path)
        assert again.buckets == 4 and again.read().count() == 200
        more = docs.unionByName(spark.createDataFrame([(900, "new"), (901, "text 5")], docs.schema))
        again.add(exact_dedup.digests(more))
        assert again.read().count() == 201
        kept = exact_dedup.exact_dedup(more, exact_dedup.DigestIndex(spark, path)).filter("kept")
        assert kept.count() == 201
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, buckets=16)
