"""Training-log analytics and reports on small cases."""
import pytest

from tessera.operators import runlog as RL
from tessera.operators import stats as ST

LOG = "run_id long, epoch long, step long, loss double, grad_norm double, val_loss double"


def test_small_losses_are_not_rounded(spark):
    df = spark.createDataFrame([(1, 0, i, v, 1.0, v) for i, v in enumerate([0.0012, 0.0034, 0.0049])], LOG)
    row = RL.epoch_means(df).first()
    assert row.mean_loss == pytest.approx(0.0095 / 3) and row.mean_val == pytest.approx(0.0095 / 3)
    got = {r.step: r.smoothed for r in RL.smooth(df, 2).collect()}
    assert got == {0: 0.0012, 1: pytest.approx(0.0023), 2: pytest.approx(0.00415)}


def test_smooth_across_blocks_and_runs(spark, monkeypatch):
    monkeypatch.setattr(RL, "BLOCK", 4)
    rows = [(run, 0, i, float(i * i % 7), 1.0, None) for run in (None, 1, 2) for i in range(11)]
    got = {(r.run_id, r.step): r.smoothed for r in RL.smooth(spark.createDataFrame(rows, LOG), 3).collect()}
    assert len(got) == 33
    for run in (None, 1, 2):
        values = [float(i * i % 7) for i in range(11)]
        for i in range(11):
            last = values[max(0, i - 2):i + 1]
            assert got[run, i] == pytest.approx(sum(last) / len(last))


@pytest.mark.parametrize("odd, mean", [("nan", float("nan")), ("inf", float("inf")), ("-inf", float("-inf")), ("1e17", 5e16 + 1), ("1e-13", 1 + 5e-14), (None, 2.0)])
def test_odd_amounts_show(spark, odd, mean):
    """A diverged or very large amount shows in the mean; nulls are left out."""
    value = float(odd) if odd else None
    df = spark.createDataFrame([(1, 0, 0, value, value, value), (1, 0, 1, 2.0, 2.0, 2.0)], LOG)
    row = RL.epoch_means(df).first()
    for got in (row.mean_loss, row.mean_grad, row.mean_val, RL.smooth(df, 2).where("step = 1").first().smoothed, RL.quick_val(df).first().quick_loss):
        assert got == pytest.approx(mean, rel=1e-15, nan_ok=True)
    tiny = spark.createDataFrame([(1, 0, i, 1e-13 * (i + 1), None, None) for i in range(3)], LOG)
    assert RL.epoch_means(tiny).first().mean_loss == pytest.approx(2e-13) and RL.epoch_means(tiny).first().mean_grad is None


def test_diverged_epochs_are_never_best(spark):
    """The loop's own rule: best = inf; an epoch below it is best, else the counter goes up."""
    nan, inf = float("nan"), float("inf")
    runs = {1: [nan, 3.0, nan, 2.0, 2.0, None, inf, 1.0], 2: [None, None, nan, inf, nan, nan, 5.0], 3: [inf, -inf, nan, 1.0], 4: [2.0, 1.0, 1.5] + [nan] * 6}
    rows, want = [], {}
    for run, losses in runs.items():
        best, counter, stopped = inf, 0, False
        for e, x in enumerate(losses):
            rows.append((run, e, x))
            is_best = x is not None and x < best
            best, counter = (x, 0) if is_best else (best, counter + 1)
            want[run, e] = (is_best, counter, counter >= 5, not stopped)
            stopped = stopped or counter >= 5
    df = spark.createDataFrame(rows, "run_id long, epoch long, mean_val double")
    got = RL.patience(RL.running_best(df), 5).collect()
    assert {(r.run_id, r.epoch): (r.is_best, r.counter, r.stop, r.trained) for r in got} == want


def test_size_guards_of_a_split_without_windows(spark):
    totals = spark.createDataFrame([("train", 600), ("val", 150)], "split string, tokens long")
    got = {r.split: (r.windows, r.batches, r.no_batches, r.batch_over_half) for r in ST.size_guards(totals, 1, 256).collect()}
    assert got == {"train": (2, 2, False, False), "val": (0, 0, True, True)}


def test_compare_runs(spark):
    runs = spark.createDataFrame([(1, 4.0, 8), (2, 2.0, 8), (3, 8.0, 8)], "run long, duration double, samples long")
    got = {r.run: (r.speedup, r.rate, r.fastest) for r in ST.compare_runs(runs, "run", "duration", "samples").collect()}
    assert got == {1: (1.0, 2.0, 2), 2: (2.0, 4.0, 2), 3: (0.5, 1.0, 2)}
