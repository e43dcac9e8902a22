"""Observations in batches give what all of them at once give, also if a batch is repeated."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from gaugewise.operators.matching import match_datasets
from gaugewise.operators.metrics import metrics_long
from gaugewise.streaming.incremental import IncrementalValidation

HOUR = 3_600_000_000
SCHEMA = "dataset string, gpi bigint, ts timestamp_ntz, value double"


def test_batches_add_up_to_all_rows(spark, tmp_path):
    rng = np.random.default_rng(41)
    rows = []
    for name in "ABC":
        for gpi in (1, 2):
            for hour in rng.choice(2000, 150, replace=False):
                rows.append((name, gpi, datetime(2020, 1, 1) + timedelta(hours=int(hour)), float(np.round(rng.normal(10, 3), 2))))
    # by time, but some rows come a batch late
    batches = [[], [], [], [], []]
    for row in rows:
        hour = (row[2] - datetime(2020, 1, 1)).total_seconds() / 3600
        late = hour % 500 > 440 and rng.random() < 0.4
        batches[min(4, int(hour // 500) + late)].append(row)
    run = IncrementalValidation(spark, str(tmp_path), "A", ("B", "C"), 6 * HOUR, 80 * HOUR, unique=True, triples=True)
    for number, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, SCHEMA)
        run.process(frame, number)
        if number in (0, 2):  # as after a crash before the batch was noted as done
            run.process(frame, number)
    # only what the next batch and a repeat of the last one need is still there
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["3", "4"]
    assert spark.read.parquet(f"{tmp_path}/state/4/pending").count() < len(rows) / 4
    got = {(r.gpi, r.combo, r.metric): r.value for r in run.metrics(4).collect()}
    matched = match_datasets(spark.createDataFrame(rows, SCHEMA), "A", ["B", "C"], 6 * HOUR, unique=True)
    wanted = {(r.gpi, r.combo, r.metric): r.value for r in metrics_long(matched, "A", ["B", "C"], triples=True).collect()}
    assert got.keys() == wanted.keys() and len(wanted) > 40
    for key, value in wanted.items():
        assert (got[key] is None) == (value is None) and (value is None or got[key] == pytest.approx(value, rel=1e-9, abs=1e-9)), key


def test_empty_batches(spark, tmp_path):
    run = IncrementalValidation(spark, str(tmp_path), "A", ("B",), HOUR, HOUR)
    for number in range(2):
        run.process(spark.createDataFrame([], SCHEMA), number)
    assert run.metrics(1).count() == 0


def test_parts_are_written_by_many_tasks(spark, sf_dir, tmp_path, monkeypatch):
    from gaugewise.plans import queries_stream

    monkeypatch.setattr(queries_stream, "checkpoint_dir", lambda _: str(tmp_path))
    settle = queries_stream.settle
    monkeypatch.setattr(queries_stream, "settle", lambda rows: settle(rows.repartition(4, "gpi", "ts")))
    queries_stream.stream_incremental(spark, sf_dir)
    assert len(list(tmp_path.glob("gaugewise/*/observations/*.parquet"))) > queries_stream.TIME_FILES
