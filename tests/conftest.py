import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from barlens.session import local_session
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def walk(spark):
    """Two random series with gaps, one of them much longer; pandas and Spark."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(7)
    frames = []
    for symbol, n in (("AAA", 900), ("BBB", 120)):
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        open_ = close + rng.normal(0, 0.5, n)
        hours = np.cumsum(rng.integers(1, 4, n))
        frames.append(pd.DataFrame({
            "symbol": symbol, "timeframe": "1h", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h"),
            "open": open_, "high": np.maximum(open_, close) + rng.random(n), "low": np.minimum(open_, close) - rng.random(n),
            "close": close, "volume": rng.integers(1, 50, n).astype(float)}))
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).cache()
