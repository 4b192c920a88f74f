"""Spread transforms against one transform of the whole series."""

import numpy as np
import pandas as pd

from tideline.operators import diagnostics
from tideline.plans import fourier


def test_all_lengths(spark):
    rng, series = np.random.default_rng(3), {}
    for n in (1, 2, 3, 16, 97, 720, 1009):
        y = rng.normal(size=n) + 3 + np.sin(np.arange(n) * 0.7)
        y[rng.random(n) < 0.1] = np.nan
        y[-1] = 1.0
        series[f"n{n}"] = y
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": k, "t": np.arange(len(y)), "y": y}) for k, y in series.items()])).replace(float("nan"), None)
    absent = df.where("y is not null")
    for rows in (df, absent):
        got = fourier.magnitudes(rows, 2000).toPandas()
        for k, y in series.items():
            want = np.abs(np.fft.rfft(np.nan_to_num(y - np.nanmean(y))))[1 : len(y) // 2 + 1]
            mine = got[got.series_id == k].sort_values("k")
            assert mine.k.to_list() == list(range(1, len(y) // 2 + 1)) and np.allclose(mine.magnitude, want, atol=1e-9 * len(y))
    top = diagnostics.periodogram(df, 3).where("series_id = 'n720'").orderBy("k").collect()
    size = np.abs(np.fft.rfft(np.nan_to_num(series["n720"] - np.nanmean(series["n720"]))))
    size[0] = 0
    assert [r.k for r in top] == sorted(np.argsort(-size)[:3].tolist()) and all(abs(r.period - 720 / r.k) < 1e-12 for r in top)


def test_without_values(spark):
    df = spark.createDataFrame([("none", 0, None), ("none", 5, None)], "series_id string, t bigint, y double")
    assert all(r.magnitude == 0 for r in diagnostics.periodogram(df).collect())
    assert diagnostics.periodogram(df.limit(0)).count() == 0
