from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", str(root / "local"))
        .config("spark.sql.warehouse.dir", str(root / "warehouse"))
        .config("spark.checkpoint.dir", str(root / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    """A DuckDB connection with the small tables as views."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(df) -> list[tuple]:
    """Rows in a fixed order, columns by name, doubles rounded."""
    frame = df if hasattr(df, "values") else df.toPandas()
    frame = frame[sorted(frame.columns)]
    tidy = lambda v: None if v is None or pd.isna(v) else f"{v:.7g}" if isinstance(v, float) else str(v)
    return sorted((tuple(tidy(v) for v in r) for r in frame.astype(object).itertuples(index=False, name=None)), key=str)


def plain_forward(w, shape, x, text):
    """(segments after injection, predictions) of one window by loops over positions, channels and kernels."""
    h = x
    for i, c_out in enumerate(shape.channels):
        kernel = w[f"conv{i}.w"].reshape(h.shape[1], shape.kernel, c_out)
        half = shape.kernel // 2
        z = np.array([[w[f"conv{i}.b"][o] + sum(h[t + k - half, c] * kernel[c, k, o] for c in range(h.shape[1]) for k in range(shape.kernel) if 0 <= t + k - half < len(h)) for o in range(c_out)] for t in range(len(h))])
        h = np.maximum(z, 0) / np.sqrt(1 + 1e-5)
    kernel = w["patch.w"].reshape(h.shape[1], shape.patch_len, shape.d_model)
    starts = range(0, len(h) - shape.patch_len + 1, shape.patch_stride)
    seg = np.array([w["patch.b"] + sum(h[s + k, c] * kernel[c, k] for c in range(h.shape[1]) for k in range(shape.patch_len)) for s in starts])
    d2 = ((seg[:, None] - w["prototypes"]) ** 2).sum(-1)
    soft = np.exp(-d2) / np.exp(-d2).sum(1, keepdims=True)
    post = seg + soft @ w["prototypes"] @ w["inject.w"] + w["inject.b"]
    t = np.maximum(text @ w["text0.w"] + w["text0.b"], 0) @ w["text1.w"] + w["text1.b"]
    return post, np.maximum(np.concatenate([post.mean(0), t]) @ w["head0.w"] + w["head0.b"], 0) @ w["head1.w"] + w["head1.b"]
