import datetime as dt

import numpy as np
import pandas as pd


def price_frame(n_assets: int = 5, n_days: int = 150, seed: int = 7, gaps: float = 0.1) -> pd.DataFrame:
    """Long prices with gaps; the last asset is listed 40 days late."""
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2020-01-01", periods=n_days)
    rows = []
    for k in range(n_assets):
        level = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n_days)))
        for i, day in enumerate(days):
            if (k == n_assets - 1 and i < 40) or (0 < i < n_days - 1 and rng.random() < gaps):
                continue
            rows.append((day.date(), f"T{k}", round(float(level[i]), 2)))
    return pd.DataFrame(rows, columns=["date", "ticker", "close"])


def wide(df: pd.DataFrame, value: str, index: str = "date") -> pd.DataFrame:
    out = df.pivot(index=index, columns="ticker", values=value).sort_index()
    out.index = pd.to_datetime(out.index)
    return out.astype(float)


def assert_wide_equal(got: pd.DataFrame, expected: pd.DataFrame, tol: float = 1e-9) -> None:
    assert list(got.columns) == list(expected.columns)
    assert len(got) == len(expected)
    np.testing.assert_allclose(got.to_numpy(float), expected.to_numpy(float), rtol=tol, atol=tol, equal_nan=True)


def month_ends(n: int) -> list[dt.date]:
    return [d.date() for d in pd.date_range("2018-01-31", periods=n, freq="ME")]
