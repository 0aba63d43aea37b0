"""Neighbouring time constants are solved together."""

import numpy as np

from wellspan.operators import solver


def test_neighbouring_time_constants_are_solved_together(monkeypatch):
    rng = np.random.default_rng(3)
    n, f = 84, np.array([0.3, 0.2, 0.0, 0.4])
    dt, rates = np.full(n, 30.4), rng.gamma(2, 20, (4, n))
    on = np.ones(n, bool)
    liq = 60 * np.exp(-np.arange(n) * 30.4 / 100) + f @ solver.filtered(rates, dt, on, np.array([100.0]))[0]
    h = solver.History(np.arange(n) * 30.4, dt, on, liq, np.ones(n), np.arange(n) < 70, 60.0, rates)
    calls, one = [], solver.bounded_least_squares

    def counted(*args):
        calls.append(args)
        return one(*args)

    monkeypatch.setattr(solver, "bounded_least_squares", counted)
    _, tau, x, slack = solver.best_fit(h, 28.0, 1830.0, 16)
    assert abs(tau / 100 - 1) < 1e-3 and np.allclose(x, f, atol=1e-3) and slack < 1e-9
    assert len(calls) < 30
    taus = np.exp(np.linspace(4.0, 6.0, 16))
    alone = [one(a, b, np.ones(4)) for a, b in zip(*solver.normal_equations(h, taus)[:2])]
    assert np.allclose([s[2] for s in solver.solved(h, taus, np.ones(4), True)], [a[0] for a in alone], atol=1e-10)
