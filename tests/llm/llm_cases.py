"""Documents with the awkward cases that every operator has to give a defined result for."""

import random

from pyspark.sql import functions as F

#: columns whose names the operators use themselves
CLASHES = ("fp", "component_id", "shard", "slot", "key", "digest", "n_lines", "pos", "h1", "lang_pred", "score",
           "start", "length", "spans", "items", "bucket", "tag", "chunk", "part")


def sentence(rng, n):
    words = ["alpha", "beta", "Gamma", "delta", "épaule", "zeta9", "eta", "theta", "iota", "kappa", "straße", "mu"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing", str(rng.randrange(30))]) for _ in range(n))


def texts(seed=5, n=60):
    """Random texts, then NULL, empty, blank, signs only, a very long one, exact copies, near copies, shared lines."""
    rng = random.Random(seed)
    common = sentence(rng, 12)
    out = ["\n".join(sentence(rng, rng.randrange(1, 25)) for _ in range(rng.randrange(1, 8))) for _ in range(n)]
    out += [None, None, "", "", " \t\n", "!!! 123 ???", "x", "\n", "\n\n"]
    out += ["\n".join(sentence(rng, 30) for _ in range(400))]
    out += [out[3]] * 5 + [out[4] + " extra", "One " + out[4], out[4].replace("alpha", "omega")]
    out += [f"{sentence(rng, 9)}\n  {common.upper()}\t\n{sentence(rng, 7)}" for _ in range(6)] + [common]
    return out


def frame(spark, rows, clashes=True, nulls=True):
    """``(doc_id, text, lang, source, n_chars)`` in several partitions, with clashing extra columns."""
    df = spark.createDataFrame([(i, t, None if nulls and (i or 0) % 7 == 0 else ("en", "de")[i % 2], "s", len(t or ""))
                                for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if clashes:
        df = df.withColumns({c: F.lit(f"clash-{c}") for c in CLASHES})
    return df.repartition(3)


def documents(spark, seed=5, clashes=True):
    rng = random.Random(seed + 1)
    all_texts = texts(seed)
    ids = rng.sample(range(1000), len(all_texts))
    return frame(spark, list(zip(ids, all_texts)), clashes), dict(zip(ids, all_texts))


def empty(spark):
    return frame(spark, []).limit(0)
