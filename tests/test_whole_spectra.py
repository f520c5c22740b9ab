"""Spectra of every step and bin, against numpy."""

import numpy as np
import pytest

from tracelake import queries as Q


def samples(spark, sf_dir):
    out = {}
    for r in Q.waveform(spark, sf_dir).orderBy("step", "step_idx").collect():
        out.setdefault(r["step"], []).append(r["y"])
    return {k: np.array(v) for k, v in out.items() if len(v) > 1}


def transformed(y):
    w = np.hanning(len(y))
    return np.fft.rfft((y - y.mean()) * w) * 2 / w.sum()


def amounts(y):
    a = np.abs(transformed(y))
    a[0] /= 2
    a[-1] /= 2 if len(y) % 2 == 0 else 1
    return a


@pytest.mark.parametrize(("name", "of"), [("fft_db_whole", lambda y: 20 * np.log10(amounts(y))), ("fft_phase_whole", lambda y: np.degrees(np.angle(transformed(y))))])
def test_all_bins(spark, sf_dir, name, of):
    found = {(r["step"], r["bin"]): r["v"] for r in Q.queries()[name](spark, sf_dir).collect()}
    expected = {(s, k): v for s, y in samples(spark, sf_dir).items() for k, v in enumerate(of(y))}
    assert found.keys() == expected.keys()
    turn = 360 if "phase" in name else np.inf
    for k, v in expected.items():
        off = abs(found[k] - v)
        assert min(off, abs(turn - off)) < 2e-5, k


def test_points_of_all_steps(spark, sf_dir):
    found = {(r["step"], r["bin"]): r["v"] for r in Q.queries()["fft_points_whole"](spark, sf_dir).collect()}
    expected = {(s, k): v for s, y in samples(spark, sf_dir).items() for k, v in enumerate(amounts(y))}
    assert len({s for s, _ in expected}) > 4
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - v) < 2e-5 for k, v in expected.items())
