"""A chunk spread over tasks against the same chunk in one piece."""

import numpy as np
import pytest
from test_kernels import frame, simulated

from basewright.operators import estimate
from basewright.operators.spread import Spread, added, color_seed


def close(a, b, most=1e-9):
    return all(np.abs(x - y).max() < most * max(1, np.abs(y).max()) for x, y in zip(a, b, strict=True))


def test_tree_adds_up_all_batches(spark):
    rows = spark.range(1000).repartition(23)
    got = added(rows, lambda b: np.array([b.num_rows, sum(b.column(0).to_pylist())], float), 2)
    assert got.tolist() == [1000, 499500] and added(rows.where("id < 0"), lambda b: np.ones(2), 2).tolist() == [0, 0]


def test_seed_equals_one_piece(spark):
    for seed, scale in ((1, 1.0), (2, 4000.0)):
        _, x = simulated(200, 3, seed)
        assert close([color_seed(frame(spark, x * scale).repartition(7))], [estimate.color_seed(x[:, 0] * scale)])
    assert (color_seed(frame(spark, np.zeros((5, 2, 4)))) == estimate.color_seed(np.zeros((5, 4)))).all()


@pytest.mark.parametrize("fast", [False, True])
def test_rounds_equal_one_piece(spark, fast):
    """Seed, fits, brightness, calls and the neighbours' light over several partitions and blocks."""
    _, x = simulated(240, 20, 5)
    rounds = estimate.schedule(0, 2, fast)
    one, many = estimate.Chunk(x), Spread(frame(spark, x).repartition(6))
    want, got = one.run(rounds, fast), many.run(rounds, fast)
    rows = got.collect()
    z = np.empty_like(want)
    for r in rows:
        z[r.cluster] = r.signal
    assert len(rows) == 240 and close([z], [want], 1e-7) and close(many.color, one.color, 1e-8) and close(many.phase, one.phase, 1e-8)


def test_one_fit_to_nine_digits(spark):
    """E4 and E5: partial Gram matrices over partitions give the fits of one piece."""
    _, x = simulated(300, 16, 6)
    one = estimate.Chunk(x)
    one.solve(range(2), -1, 30.0, lambda b: True)
    many = Spread(frame(spark, x).repartition(9), estimate.Params(one.color, one.phase))
    many._solved(-1, 30.0, lambda b: True)
    r = estimate.Round(0.05, 30.0, 2, False)
    assert close(many._fitted("phase_sums", "fit_phase", r, lambda b: (many.plan[b][4] + 2, many.plan[b][2])), [one.fit_phase(b, 0.05, 2) for b in range(2)])
    assert close(many._fitted("color_sums", "fit_color", r, lambda b: (5, 4)), [one.fit_color(b, 0.05, 2) for b in range(2)])


def test_warm_parameters_without_rounds(spark):
    _, x = simulated(80, 12, 7)
    one = estimate.Chunk(x)
    one.run(estimate.schedule(0, 2, False))
    again, many = estimate.Chunk(x, one.params()), Spread(frame(spark, x).repartition(3), one.params())
    want = again.run([], True)
    assert all(np.abs(np.array(r.signal) - want[r.cluster]).max() < 1e-9 for r in many.run([], True).collect())
