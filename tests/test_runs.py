"""Run tables: a run is read once it is whole."""

import pytest

from shelfcast.plans import runs


def test_a_run_that_was_cut_short_is_not_read(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "runs")
    runs.append_run(spark, root, "first", {"a": 1}, {"m": 1.0}, {"t": "x"}, [("f", 0.5)])
    append = runs._append

    def fails(at):
        def stop(spark, root, table, rows):
            if table == at:
                raise OSError("lost")
            append(spark, root, table, rows)

        return stop

    for at in runs.TABLES:
        monkeypatch.setattr(runs, "_append", fails(at))
        with pytest.raises(OSError, match="lost"):
            runs.append_run(spark, root, f"cut at {at}", {"a": 2}, {"m": 2.0}, {"t": "y"}, [("f", 1.0)])
    monkeypatch.setattr(runs, "_append", append)
    assert spark.read.parquet(f"{root}/run_metrics").count() > 1
    for table in runs.TABLES:
        assert runs.read_table(spark, root, table).count() == 1
    runs.append_run(spark, root, "bare")
    assert runs.read_table(spark, root, "runs").count() == 2 and runs.read_table(spark, root, "run_params").count() == 1


def test_scores_come_back_from_the_tables(spark, tmp_path):
    root = str(tmp_path / "runs")
    scores = {"full": (3.0, 20.0, 5.0), "seed_1": (4.0, 22.0, 6.0), "none": (5.0, 10.0, 7.0)}
    for name, values in scores.items():
        keys = ("valid_rmse", "valid_mape", "valid_wape")
        runs.append_run(spark, root, name, metrics=dict(zip(keys, values, strict=True)))
    logged = runs.read_table(spark, root, "runs"), runs.read_table(spark, root, "run_metrics")
    table = runs.logged_scores(*logged)
    assert {r["label"]: (r["rmse"], r["mape"], r["wape"]) for r in table.collect()} == scores
    base = spark.createDataFrame([("base", 6.0, 40.0, 8.0)], "label string, rmse double, mape double, wape double")
    rows = {r["name"]: r for r in runs.ablation_table(table.unionByName(base), "base").collect()}
    assert set(rows) == set(scores)
    assert (rows["seed_1"]["mape_vs_full"], rows["none"]["improve_vs_baseline_pct"]) == (2.0, 75.0)
    values = runs.run_values(*logged, "valid_mape")
    floor = runs.noise_floor(values, ["full", "seed_1"]).first()
    assert (floor["runs"], floor["mean"], floor["range"]) == (2, 21.0, 2.0)
    inside = {r["name"]: r["inside_band"] for r in runs.against_noise(values, ["full", "seed_1"], ["none", "full"]).collect()}
    assert inside == {"none": False, "full": True}


def test_held_out_scores_are_keyed_by_window_label_and_measure(spark, tmp_path):
    root = str(tmp_path / "runs")
    scores = spark.createDataFrame(
        [("test", "model", 5, 1.5, None), ("test", "base", 5, 3.0, 0.5)], "split string, label string, n_scored long, rmse double, gain double"
    )
    runs.log_holdout(spark, root, scores, {"config": "x"})
    found = {r["key"]: r["value"] for r in runs.read_table(spark, root, "run_metrics").collect()}
    assert found == {"test/model/n_scored": 5, "test/model/rmse": 1.5, "test/base/n_scored": 5, "test/base/rmse": 3.0, "test/base/gain": 0.5}
