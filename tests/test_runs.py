import pytest

from corpusloom.operators import runs as R
from corpusloom.sources import logs as LG

LINES = [
    "step:125/1770 train_loss:4.5000 val_loss:4.2500 train_time:18750ms step_avg:150.00ms",
    "step:126/1770 train_time:18900ms step_avg:150.00ms",
    "*** Saved best checkpoint ***",
    "step:x/1770 val_loss:.",
]


def test_log_lines(spark, tmp_path):
    (tmp_path / "run7.txt").write_text("\n".join(LINES))
    got = LG.read_run_logs(spark, str(tmp_path), r"run(\d+)").orderBy("line").collect()
    by_line = {r.line: r for r in got}
    full, bare, other, broken = (by_line[x] for x in LINES)
    assert (full.run, full.step, full.total_steps, full.train_loss, full.val_loss) == ("7", 125, 1770, 4.5, 4.25)
    assert (full.train_time, full.step_avg) == (18750, 150.0)
    assert bare.train_loss is None and bare.val_loss is None and bare.step == 126
    assert other.step is None and broken.step is None and broken.val_loss is None


def test_checkpoint_listing(spark, tmp_path):
    for name in ("a/best_state_step000125_val4.2500.pt", "a/b/best_state_step000250_val4.2500.pt", "a/last.pt"):
        file = tmp_path / "models" / "text" / "small" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x")
    found = LG.list_checkpoints(spark, str(tmp_path))
    assert sorted((r.representation, r.size, r.step, r.val_loss) for r in found.collect()) == [
        ("text", "small", 125, 4.25), ("text", "small", 250, 4.25),
    ]
    best = R.best_per_group(found)
    assert [(r.step, r.val_loss) for r in best.collect()] == [(250, 4.25)]  # equal loss: the later step
    wanted = spark.createDataFrame([("text", "small"), ("text", "large")], "representation string, size string")
    with pytest.raises(Exception, match="no checkpoint for text/large"):
        R.require_found(best, wanted).collect()


def test_best_so_far_needs_a_strict_improvement(spark):
    data = [("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, 2.0), ("a", 4, 2.5), ("a", 300000, 1.0), ("b", 5, 9.0), ("c", 1, None)]
    got = R.best_so_far(spark.createDataFrame(data, "run string, step long, val_loss double"))
    assert sorted((r.run, r.step, r.prev_best) for r in got.collect() if r.prev_best) == [("a", 3, 3.0), ("a", 300000, 2.0)]
    assert got.count() == 4


def test_summary_and_windows(spark):
    data = [("a", s, float(s), 10.0 - s if s % 3 == 0 else None, 150.0) for s in range(1, 8)] + [("b", 1, 1.0, None, 2.0)]
    df = spark.createDataFrame(data, "run string, step long, train_loss double, val_loss double, step_avg double")
    got = {r.run: r for r in R.run_summary(df).collect()}
    assert (got["a"].best_val, got["a"].last_val, got["a"].last_step) == (4.0, 4.0, 7)
    assert got["b"].best_val is None and got["b"].last_val is None
    windows = {(r.run, r.eval_no): (r.eval_step, r.steps, r.mean_train_loss) for r in R.train_loss_since_eval(df).collect()}
    assert windows == {
        ("a", 0): (3, 3, 2.0), ("a", 1): (6, 3, 5.0), ("a", 2): (None, 1, 7.0), ("b", 0): (None, 1, 1.0),
    }
