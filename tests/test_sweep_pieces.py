"""The sweep draws its samples in pieces."""

import numpy as np
import pytest

from tideline.operators import reports


def test_sweep_in_pieces_gives_the_same_estimates(spark):
    got = {(round(r["mu"], 6), r["kappa"]): r["mu_fit"] for r in reports.rep_vm_sweep(spark, n=1001, step=24, piece=100).collect()}
    for i in (0, 7, 19):
        mu = -np.pi + i * (2 * np.pi / 19)
        for kappa in (1, 25, 49):
            whole = np.exp(1j * np.random.default_rng([0, kappa, i]).vonmises(mu, kappa, 1001)).mean()
            assert got[round(mu, 6), kappa] == pytest.approx(np.angle(whole), abs=1e-9)
