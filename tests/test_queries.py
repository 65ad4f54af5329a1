"""Every query with an SQL twin gives its rows; the others run."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tandemlab.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for path in Path(DIR).glob("*.parquet"):
        made.sql(f"create view {path.stem} as select * from '{path}'")
    return made


def plain(frame: pd.DataFrame) -> list[tuple]:
    def value(x):
        if isinstance(x, str | bool):
            return str(x)
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "null"
        return str(x) if isinstance(x, pd.Timestamp) else f"{float(x):.7g}"

    return sorted(tuple(map(value, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    want = con.sql(ORACLES[name]).df()
    found = QUERIES[name](spark, DIR).toPandas()
    assert set(found.columns) == set(want.columns)
    assert plain(found[list(want.columns)]) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 7  # user 14 has no partner
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_part(tmp_path):
    shutil.copytree(REPO / "tandemlab", tmp_path / "tandemlab", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and e.oracle_sql() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_models_read_all_dimensions(spark, tmp_path):
    """The label lies in dimensions 16 and up; those before are noise."""
    rng = np.random.default_rng(3)
    label = np.arange(400) // 40
    x = rng.normal(size=(400, 64))
    x[:, 16:] += 2 * np.where(label < 5, 1, -1)[:, None]
    frame = pd.DataFrame({"vec_id": np.arange(400), "embedding": x.astype(np.float32).tolist(), "label": label.astype(np.int32)})
    spark.createDataFrame(frame, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    at = str(tmp_path)
    assert all(r.auc > 0.99 for r in QUERIES["ml_leave_one_group_out"](spark, at).collect())
    sides = {}
    for r in QUERIES["ml_kmeans"](spark, at).collect():
        sides.setdefault(r.cluster, set()).add(bool(label[r.vec_id] < 5))
    assert all(len(v) == 1 for v in sides.values())
    found = QUERIES["ml_pca"](spark, at).orderBy("vec_id").toPandas()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    want = z @ np.linalg.svd(z, full_matrices=False)[2][0]
    assert np.allclose(np.abs(found.pc1), np.abs(want), atol=1e-3)
    assert sorted(r.feature for r in QUERIES["ml_importance"](spark, at).collect()) == list(range(64))


def events_at(spark, path, rows):
    """One file of events in the order of rows: (user_id, millisecond, event_type, value, k)."""
    start = pd.Timestamp("2024-01-01")
    frame = pd.DataFrame([(n, start + pd.Timedelta(milliseconds=t), u, kind, x, f'{{"k": {k}}}') for n, (u, t, kind, x, k) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    spark.createDataFrame(frame, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_tertiles_of_equal_scores(spark, tmp_path):
    """The same three values summed in two orders are one score."""
    values = [(0.1, 0.2, 0.3), (0.3, 0.2, 0.1)]
    at = events_at(spark, tmp_path, [(2 * d, k, "view", x, 1) for d in range(12) for k, x in enumerate(values[d % 2])])
    assert {r.tertile for r in QUERIES["win_tertiles"](spark, at).collect()} == {"easy"}


def test_offset_in_whatever_order(spark, con, tmp_path):
    """The mean over clicks is 142, which a sum of another order misses; two errors share a time."""
    values = [37.18, 198.51, 171.99, 400.32]
    rows = [(0, k, "click", x, 1) for k, x in enumerate(values)] + [(0, 9, "view", 5.0, 1)] + [(2, 5, "error", x, 1) for x in (3.0, 4.0)]
    at = events_at(spark, tmp_path, rows)
    spark.read.parquet(f"{at}/events.parquet").orderBy(F.desc("event_id")).coalesce(1).write.parquet(f"{tmp_path}/back/events.parquet")
    want = [(0, 3, "lsl", 142.0), (1, 3, "manual", 3.0)]
    for path in (at, f"{tmp_path}/back"):
        assert sorted(map(tuple, QUERIES["ts_offset_pick"](spark, path).collect())) == want
    made = con.cursor()
    made.sql(f"create temp view events as from '{at}/events.parquet/*.parquet'")
    assert sorted(made.sql(ORACLES["ts_offset_pick"]).fetchall()) == want


def test_hull_as_its_sql(spark, con, tmp_path):
    """Three points in line, whose products of doubles round apart; points without a coordinate, and without numbers."""
    box = [(0.0, 0), (4.0, 0), (4.0, 1), (0.0, 1)]
    drawings = {0: [(9.88, 11), (4.48, 21), (1.78, 26), (4.48, 21)], 1: [*box, (None, 5), (9.0, "null")], 2: [(None, 1)], 4: [(1.0, "null"), (2.0, 3)], 6: [*box, (float("nan"), 5)], 8: [*box, (float("inf"), 5)], 10: box[:2]}
    at = events_at(spark, tmp_path / "all", [(u, n, "view", -1.0 if x is None else x, k) for u, points in drawings.items() for n, (x, k) in enumerate(points)])
    rows = spark.read.parquet(f"{at}/events.parquet")
    rows.withColumn("value", F.when(F.col("value") != -1, F.col("value"))).unionAll(rows.limit(1).withColumn("user_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/events.parquet")
    key = lambda r: tuple(str(v) for v in r)
    found = sorted((tuple(r) for r in QUERIES["geo_hull"](spark, str(tmp_path)).collect()), key=key)
    made = con.cursor()
    made.sql(f"create temp view events as from '{tmp_path}/events.parquet/*.parquet'")
    assert found == sorted(made.sql(ORACLES["geo_hull"]).fetchall(), key=key)
    assert {r[0]: r[3] for r in found if r[2] == "matcher"} == {0: 36.0, None: 0.0}
