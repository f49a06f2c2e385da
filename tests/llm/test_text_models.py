import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import documents, empty, frame, sentence

from tremorlake.llm import decontam, langid, lm_score, quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(texts, items, window):
    windows = {}
    for item, text in items:
        w = split_words(text)
        for i in range(max(1, len(w) - window + 1)):
            if w:
                windows.setdefault(tuple(w[i:i + min(window, len(w))]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in texts.items():
        w = split_words(t)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out[d] = (len(w), hit, sorted(found))
    return out


def benchmark(spark, texts, seed=3):
    """Items that share passages with documents and with each other, short ones, one inside another, empty ones."""
    rng = random.Random(seed)
    words = split_words(" ".join(t for t in texts.values() if t))
    items = []
    for i in range(25):
        a = rng.randrange(len(words) - 60)
        items.append((i, " ".join(words[a:a + rng.choice([3, 9, 10, 11, 25])]) + "; " + sentence(rng, rng.randrange(6))))
    items += [(40, "alpha"), (41, "alpha beta"), (42, ""), (43, None), (44, "!!!"), (45, items[0][1]), (None, "gamma")]
    items += [(46, "kappa " * 12), (47, "kappa " * 4)]
    return spark.createDataFrame(items, "item_id long, text string"), [x for x in items if x[0] is not None]


@pytest.mark.parametrize("window,block_words", [(10, 100_000), (4, 100_000), (10, 40)])
def test_hits_match_brute_force(spark, window, block_words):
    df, texts = documents(spark)
    texts = {**texts, 5000: "a kappa " + "Kappa, " * 15 + "z kappa-kappa"}
    df = df.unionByName(frame(spark, [(5000, texts[5000])]))
    items_df, items = benchmark(spark, texts)
    rows = decontam.contamination(df, items_df, window, block_words).collect()
    want = brute_hits(texts, items, window)
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, found = want[r.doc_id]
        assert r.n_words == n and {i for s in r.spans for i in range(s.start, s.end)} == hit
        assert sorted(r["items"]) == found
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) or len(r.spans) < 2


@pytest.mark.parametrize("block_words", [100_000, 5])
def test_cut_texts_keep_everything_else(spark, block_words):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Clean start, {passage.upper()}! clean end of a longer text with many other words in it"), (2, passage),
            (3, "clean"), (4, None), (5, ""), (6, "ten short words, ünïcode – one two three four five")]
    items = spark.createDataFrame([(1, passage), (2, "xx yy")], "item_id long, text string")
    df = frame(spark, rows)
    got = {r.doc_id: r.text for r in decontam.decontaminate(df, items, block_words=block_words).collect()}
    assert got == {1: "Clean start, ! clean end of a longer text with many other words in it", 3: "clean", 4: None, 5: "",
                   6: rows[5][1]}
    assert decontam.decontaminate(df, items).columns == df.columns


def test_decontam_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df, texts = documents(spark)
    rows = decontam.contamination(df, none).collect()
    assert len(rows) == len(texts) and not any(r.spans for r in rows)
    items, _ = benchmark(spark, texts)
    assert decontam.contamination(empty(spark), items).collect() == []


def test_language_filter_learns_and_predicts(spark):
    rng = random.Random(6)
    parts = {"en": ["the", "ing", "er", "tion", "th", "wh"], "de": ["sch", "keit", "ung", "ei", "zu", "ß"],
             "fr": ["eau", "oux", "é", "que", "ment", "ç"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang))
    rows += [(1000, None, "en"), (1001, "12 !!", "de"), (1002, "", None), (1003, "the tion" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.learn(df.filter("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in langid.identify(df, model, ["doc_id", "lang"]).collect()}
    held = [i for i in range(600) if i % 4 == 2]
    assert sum(got[i].lang_pred == got[i].lang for i in held) >= 0.99 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows)


def test_masks_hold_all_languages_of_a_gram():
    grams = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    model = langid.LanguageFilter([f"l{i}" for i in range(70)], np.zeros((1 << 14, 2), np.uint64), 4, 3)
    for i, own in ((0, grams[:200]), (69, grams[100:300])):
        for s in model.slots(own):
            model.bits[s, i >> 6] |= np.uint64(1) << np.uint64(i & 63)
    masks = model.masks(grams)
    first, last = masks[:, 0] & np.uint64(1), masks[:, 1] >> np.uint64(5) & np.uint64(1)
    assert first[:200].all() and last[100:300].all()
    wrong = (first[200:].sum() + last[:100].sum() + last[300:].sum()) / 400
    assert wrong < 0.02 and abs(model.false_rate()[0] - (200 * 3 / (1 << 14)) ** 3) < 1e-3


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(sentence(random.Random(1), 3000).split())
    whole = Counter()
    for _, pieces in langid._slabs([text], 4):
        whole.update(langid.gram_hashes(pieces, 4)[0].tolist())
    monkeypatch.setattr(langid, "SLAB", 997)
    parts = Counter()
    for _, pieces in langid._slabs([text], 4):
        parts.update(langid.gram_hashes(pieces, 4)[0].tolist())
    assert parts == whole


def test_language_edges(spark):
    df, texts = documents(spark)
    nothing = langid.learn(df.filter("lang = 'zz'"))
    assert {r.lang_pred for r in langid.identify(df, nothing, ["doc_id"]).collect()} == {"und"}
    model = langid.learn(df)
    assert langid.identify(empty(spark), model, ["doc_id"]).collect() == []
    rows = langid.identify(df, model, df.columns).collect()  # its own columns replace those of the same names
    assert len(rows) == len(texts) and {r.lang_pred for r in rows} <= {"en", "de", "und"} and rows[0].pos == "clash-pos"


def labelled(spark, n=800):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        t = sentence(rng, rng.randrange(20, 80)) + "."
        if not good:
            t = rng.choice([t.upper() + "!!", "Spam " * 40, t.replace(" ", "### "), t.replace(" ", " | ")])
        rows.append((i, t))
        labels.append((i, int(good)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_ranks_held_out_documents(spark):
    docs, labels = labelled(spark)
    model = quality.learn(docs, labels.filter("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id % 5 == 0}
    good = [got[d] for d, y in truth.items() if y]
    bad = [got[d] for d, y in truth.items() if not y]
    assert sum(g > b for g in good for b in bad) / len(good) / len(bad) > 0.99
    assert sum(g >= 0.3 for g in good) / len(good) > 0.95 and sum(b < 0.3 for b in bad) / len(bad) > 0.95


def test_quality_threshold_sees_all_labels_when_the_sample_bites(spark):
    docs, labels = labelled(spark, 2000)
    model = quality.learn(docs, labels, train_docs=300)
    rows = quality.score(docs, model, ["doc_id"]).join(labels, "doc_id").collect()
    below = sum(r.score < 0.3 for r in rows)
    assert len(rows) == 2000 and below == sum(r.quality == 0 for r in rows)
    few = quality.learn(docs, labels.filter("doc_id < 0"))
    assert few.threshold == 0.0


def test_pairwise_loss_gradient_is_zero_at_the_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, quality.N_FEATURES))
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > -0.8).astype(int)
    m = quality.fit_pairs(x, y, 5000, 1e-2, 0.3)
    z = (x - m.mean) / m.scale
    good, bad, k = np.flatnonzero(y == 1), np.flatnonzero(y == 0), np.arange(5000)
    diff = z[good[(k + k // len(good)) % len(good)]] - z[bad[k % len(bad)]]
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean() + 1e-2 * w @ w / 2
    for _ in range(20):
        assert loss(m.weights + 1e-3 * rng.normal(size=len(m.weights))) >= loss(m.weights) - 1e-9
    assert abs((m.latent(x) < m.threshold).sum() - len(bad)) <= 1 and m.score(x[:1] * 0 + m.mean).shape == (1,)


def test_quality_edges(spark):
    docs, texts = documents(spark)
    one_kind = spark.createDataFrame([(d, 1) for d in texts] + [(None, 0), (-5, 0)], "doc_id long, quality int")
    model = quality.learn(docs, one_kind)
    scores = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert len(scores) == len(texts) and all(abs(s - 0.3) < 1e-12 for s in scores.values())
    assert quality.score(empty(spark), model, ["doc_id"]).collect() == []
    docs, labels = labelled(spark, 200)
    model = quality.learn(docs, labels.unionByName(labels))
    odd = frame(spark, [(1, None), (1, None), (2, ""), (3, "x" * 3_000_000)])
    got = quality.score(odd, model, odd.columns).collect()
    assert len(got) == 4 and len({r.score for r in got if not r.text}) == 1 and all(0 <= r.score <= 1 for r in got)


def brute_scores(texts, corpus, order, least, backoff):
    cut = lambda t: [w for w in re.split("[ \t\n\x0b\x0c\r]+", (t or "").translate(LOWER)) if w]
    counts = [Counter() for _ in range(order + 1)]
    for t in corpus:
        w = cut(t)
        for n in range(1, order + 1):
            counts[n].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    total = sum(counts[1].values())
    out = []
    for d, t in texts:
        w, score = cut(t), 0.0
        for i in range(len(w)):
            penalty = 0.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1:i + 1])
                if n == 1:
                    score += math.log(max(counts[1][gram], 1) / total) + penalty
                elif counts[n][gram] >= least:
                    score += math.log(counts[n][gram] / counts[n - 1][gram[:-1]]) + penalty
                    break
                else:
                    penalty += math.log(backoff)
        out.append((d, len(w), round(score, 5)))
    return sorted(out)


@pytest.mark.parametrize("order,least,chunk_bytes,group_words", [(3, 2, 1 << 24, 1 << 20), (2, 1, 3000, 64), (4, 3, 500, 16)])
def test_backoff_scores_match_brute_force(spark, order, least, chunk_bytes, group_words):
    df, texts = documents(spark)
    rows = lm_score.stupid_backoff(df, order=order, min_count=least, chunk_bytes=chunk_bytes, group_words=group_words)
    got = sorted((r.doc_id, r.n_words, round(r.log_score, 5)) for r in rows.collect())
    want = brute_scores(texts.items(), texts.values(), order, least, 0.4)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-3)


def test_backoff_against_another_corpus_and_edges(spark):
    docs = [(1, "a b c"), (1, "a b c"), (2, None), (3, " \n"), (4, "new words a b")]
    corpus = [(i, "a b c a b") for i in range(3)]
    rows = lm_score.stupid_backoff(frame(spark, docs), frame(spark, corpus)).collect()
    got = sorted((r.doc_id, r.n_words, round(r.log_score, 5)) for r in rows)
    assert got == brute_scores(docs, [t for _, t in corpus], 3, 2, 0.4)
    assert lm_score.stupid_backoff(empty(spark)).collect() == []


def test_squeezed_arrays_come_back():
    for x in ([], [0], [1, 255, 256, 2 ** 40], [2 ** 55]):
        a = np.array(x, np.uint64)
        assert lm_score._expand(lm_score._squeeze(a)).tolist() == x
