"""Near rows of the other side against all pairs, and planted noisy copies."""

import numpy as np
import pandas as pd
import pytest

from tremorlake.operators.near_overlap import near_overlap


def _brute(pdf, cols, radius):
    z = pdf[cols].replace([np.inf, -np.inf], np.nan)
    std = z[pdf["side"].notna()].std()
    z = z[[c for c in cols if std[c] > 0]] / std[std > 0]
    ok = pdf[cols].map(np.isfinite).all(axis=1).to_numpy()
    side = pdf["side"].to_numpy()
    other = z[(side == False) & ok].to_numpy()  # noqa: E712
    out = {}
    for i in np.flatnonzero(side == True):  # noqa: E712
        d = np.sqrt(((other - z.iloc[i].to_numpy()) ** 2).sum(axis=1)) if ok[i] else np.array([])
        out[int(pdf["id"][i])] = int((d <= radius).sum())
    return out


@pytest.mark.parametrize("radius", [0.05, 0.4, 3.0])
def test_near_rows_equal_all_pairs(spark, radius):
    rng = np.random.default_rng(3)
    n = 1500
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.integers(0, 5, n) * 1.0,
                        "c": 1e6 + rng.normal(size=n), "still": 4.0})
    pdf.loc[:499, ["a", "b", "c"]] = [0.5, 1.0, 1e6]  # a third of the rows is one hot row
    pdf.loc[500, "a"], pdf.loc[501, "c"], pdf.loc[502, "b"] = np.nan, np.inf, -np.inf
    pdf["side"] = pd.Series([None if i % 50 == 7 else bool(i % 3 == 0) for i in range(n)], dtype=object)
    df = spark.createDataFrame(pdf.astype({"id": "int64"}), "id long, a double, b double, c double, still double, side boolean")
    got = {r["id"]: r for r in near_overlap(df, ["a", "b", "c", "still"], "side", "id", radius).collect()}
    assert {k: r["n_near"] for k, r in got.items()} == _brute(pdf, ["a", "b", "c", "still"], radius)
    assert all((r["nearest"] is None) == (r["n_near"] == 0) and (r["nearest"] or 0) <= radius for r in got.values())


def test_noisy_copies_across_a_split_are_found(spark):
    rng = np.random.default_rng(8)
    train = pd.DataFrame(rng.normal(size=(4000, 6)), columns=list("abcdef"))
    copies = train.sample(300, random_state=1) + rng.normal(0, 0.01, (300, 6))
    fresh = pd.DataFrame(rng.normal(size=(300, 6)) + 0.0, columns=list("abcdef"))
    pdf = pd.concat([train.assign(side=False), copies.assign(side=True), fresh.assign(side=True)], ignore_index=True)
    pdf["id"] = np.arange(len(pdf))
    got = near_overlap(spark.createDataFrame(pdf), list("abcdef"), "side", "id", 0.1).toPandas().set_index("id")["n_near"]
    assert (got.loc[4000:4299] > 0).mean() >= 0.99 and (got.loc[4300:] > 0).mean() < 0.05


def test_no_rows_on_a_side(spark):
    df = spark.createDataFrame([(1, 2.0, True), (2, 2.0, True)], "id long, a double, side boolean")
    assert {(r["id"], r["n_near"]) for r in near_overlap(df, ["a"], "side", "id").collect()} == {(1, 0), (2, 0)}
    assert near_overlap(df.limit(0), ["a"], "side", "id").count() == 0
    with pytest.raises(ValueError):
        near_overlap(df, ["a"], "side", "id", 0.0)
