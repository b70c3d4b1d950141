"""The structure chain on drawn frames."""

import numpy as np
import pytest

from sparkloom.operators import catalog, structure

SHAPE, PIXEL = (64, 64), 0.125


def _tile(spark, *images):
    return spark.createDataFrame([("f", k, *SHAPE, np.asarray(x, float).ravel().tolist()) for k, x in enumerate(images)], "file_id string, frame int, h int, w int, data array<double>")


def test_structure_of_drawn_bars(spark):
    bars, middle, strip = (np.zeros(SHAPE) for _ in range(3))
    for c in (4, 20, 36, 52):
        bars[8:56, c : c + 3] = 1.0
    for c in (13, 29, 45):
        middle[8:56, c] = 1.0
    strip[8:56, 4:55] = 1.0
    empty = np.zeros(SHAPE)
    tiles = {"image": _tile(spark, bars, empty), "zbands": _tile(spark, bars, empty), "midlines": _tile(spark, middle, empty), "cell_mask": _tile(spark, strip, empty), "sarcomere_mask": _tile(spark, strip, empty), "sine": _tile(spark, empty, empty), "cosine": _tile(spark, empty + 1, empty + 1)}
    rows = structure.structure(tiles, PIXEL, SHAPE, area_min=1.0, growth={"share": 0.3, "reach": 0.3, "n_min": 3}).orderBy("frame").collect()
    full, none = rows
    assert {name for name, _, _ in catalog.FEATURES} <= set(full.asDict())
    cell = 48 * 51 * PIXEL**2
    assert full.cell_mask_area == pytest.approx(cell) and full.cell_mask_area_ratio == pytest.approx(48 * 51 / 64**2)
    assert full.cell_mask_intensity == pytest.approx(12 / 51) and full.sarcomere_area_ratio == pytest.approx(1.0)
    assert full.n_zbands == 4 and full.z_mask_area == pytest.approx(4 * 48 * 3 * PIXEL**2) and full.z_mask_intensity == 1.0
    assert full.z_mask_area_ratio == pytest.approx(12 / 51) and full.z_straightness_mean == pytest.approx(1.0) and full.z_oop == pytest.approx(1.0)
    assert full.z_length_mean == pytest.approx(48 * PIXEL, abs=4 * PIXEL)
    assert full.n_mbands == 3 and full.n_vectors >= 3 * 44 and full.sarcomere_oop == pytest.approx(1.0)
    assert full.sarcomere_length_mean == pytest.approx(16 * PIXEL, abs=0.02) and full.sarcomere_length_std < 0.02
    assert full.myof_straightness_mean == pytest.approx(1.0, abs=1e-3) and full.myof_bending_mean == pytest.approx(0.0, abs=1e-3)
    assert full.n_domains == 1 and full.domain_oop_mean == pytest.approx(1.0)
    assert (none.n_zbands, none.n_vectors, none.n_lines, none.n_domains) == (0, 0, 0, 0) and none.cell_mask_area == 0 and none.sarcomere_area_ratio is None and none.z_length_mean is None


def test_ends_point_out_of_their_band(spark):
    bar = np.zeros(SHAPE)
    bar[10:40, 30:33] = 1.0
    t, flat = _tile(spark, bar), _tile(spark, np.zeros(SHAPE))
    bands, ends = structure.bands_and_ends(t, t, flat, PIXEL)
    assert bands.count() == 1
    found = {round(float(np.sin(r.dir))): r.y for r in ends.collect()}
    assert set(found) == {-1, 1} and found[-1] < found[1]
