"""Spectra in parts: short series go to Python many at a time."""

import numpy as np
import pyarrow as pa
import pytest

from tracelake.operators import spectral


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_whole_groups_however_batches_fall(size):
    """Groups are told apart by their numbers, and by a fall of what rises in them, also across batches; each comes once and whole."""
    groups = [(7, 0, [0, 1, 2, 3]), (7, 1, [0]), (7, 2, [0, 1]), (9, 2, [2, 3, 4, 5, 6, 7]), (9, 2, [0, 1, 2]), (9, 3, [3])]
    rows = pa.table({"hash": [h for h, _, at in groups for _ in at], "part": [p for _, p, at in groups for _ in at], "at": [v for _, _, at in groups for v in at]})
    found = []
    for table, bounds in spectral._whole_groups(iter(rows.to_batches(size)), ["hash", "part"], "at"):
        assert bounds[0] == 0 and bounds[-1] == table.num_rows
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            own = table.slice(lo, hi - lo)
            found.append((own["hash"][0].as_py(), own["part"][0].as_py(), own["at"].to_pylist()))
    assert found == groups
    assert list(spectral._whole_groups(iter([]), ["hash", "part"], "at")) == []


def test_many_short_series(spark):
    """Python isn't called for each part of each series, and the rows are those of whole series."""
    random = np.random.default_rng(6)
    rows = [(f"run {k}", at, at * 0.5, float(random.normal())) for k in range(60) for at in range(2 + k % 9)]
    df = spark.createDataFrame(rows, "step string, step_idx bigint, x double, y double")
    split = spectral.fft_in_parts(df, ["y"], 2, name="hamming", pad=True, keep_dc=True)
    assert "FlatMapGroups" not in split._jdf.queryExecution().optimizedPlan().toString()
    found = {r[:2]: r[2:] for r in split.collect()}
    expected = {r[:2]: r[2:] for r in spectral.fft(df, ["y"], name="hamming", pad=True, keep_dc=True).collect()}
    assert found.keys() == expected.keys()
    assert all(np.allclose(found[k], expected[k], atol=1e-9) for k in found)
