"""Chains on synthetic lines and frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import pipelines


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "file_id string, frame int, vec_id long, y double, x double, angle double, len double, midline_id int, midline_len double")


def test_vector_features_and_domains(spark):
    rows = [("f", 0, i, 0.0, 2.0 * i, 0.0, 2.0, i // 4, 1.0) for i in range(12)] + [("f", 0, 100 + i, 50.0 + 2.0 * i, 50.0, np.pi / 2, 2.0, 50, 1.0) for i in range(12)]
    v = _vectors(spark, rows)
    f = pipelines.vector_features(v).first()
    assert f.n_vectors == 24 and f.n_mbands == 4 and f.sarcomere_oop == pytest.approx(0, abs=1e-9) and f.sarcomere_length_mean == 2.0
    d = {r.vec_id: r.community for r in pipelines.domains(v, 1.0, resolution=0.01).collect()}
    assert len({d[i] for i in range(12)} & {d[100 + i] for i in range(12)}) == 0


def test_bands_link_end_to_end(spark):
    ends = []
    for band, y in enumerate((0.0, 2.0, 4.0)):
        ends += [("f", 0, band, 0, y, 0.0, -np.pi / 2), ("f", 0, band, 1, y + 1.5, 0.0, np.pi / 2)]
    e = spark.createDataFrame(ends, "file_id string, frame int, band long, end int, y double, x double, dir double")
    links = pipelines.band_links(e, 1.0)
    assert sorted((r.a, r.b, round(r.dist, 3), round(r.alignment, 3)) for r in links.collect()) == [(0, 1, 0.5, 1.0), (1, 2, 0.5, 1.0)]
    bands = spark.createDataFrame([("f", 0, i, 1.5, 1.0, 0.3, 0.0) for i in range(4)], "file_id string, frame int, band long, length double, straightness double, intensity double, orientation double")
    r = pipelines.band_features(bands, links).first()
    assert (r.n_zbands, r.z_lat_neighbors_mean, r.z_lat_size_groups_mean) == (4, 1.0, 2.0) and r.z_lat_length_groups_mean == pytest.approx((4.5 + 1.0 + 1.5) / 2)


@pytest.mark.parametrize("mode", ["longest_in_cluster", "fit_straight_line", "random_in_cluster", "random_line"])
def test_lines_of_interest(spark, mode):
    rows = [("k", 100 * r + i, 100.0 * r, 2.0 * i, 0.0, 2.0, 1.0) for r in range(3) for i in range(10 + r)]
    v = spark.createDataFrame(rows, "key string, id long, y double, x double, angle double, len double, midline_len double")
    out = pipelines.lines_of_interest(v, "key", mode, 2, {"n": (5, 50)}, share=0.3, persistence=3, reach=0.5, n_min=4).collect()
    assert len(out) == 2
    if mode == "longest_in_cluster":
        assert [r.n for r in out] == [12, 11]
    if mode == "fit_straight_line":
        assert out[0].slope == pytest.approx(0) and (out[0].x0, out[0].x1) == (-2.0, 24.0)
    with pytest.raises(ValueError):
        pipelines.lines_of_interest(v, "key", "other").count()


def test_motion_of_a_beating_line(spark):
    dt, frames, n = 0.05, 160, 9
    t = np.arange(frames)
    beat = ((t % 50) >= 20) & ((t % 50) < 36)
    pull = np.convolve(np.where(beat, 0.3, 0.0), np.hanning(7) / np.hanning(7).sum(), mode="same")
    x = np.arange(0, 20, 0.05)
    rows = []
    for f in range(frames):
        z = 1.0 + (1.9 - pull[f]) * np.arange(n)
        rows.append(("l", f, x.tolist(), (10 * np.exp(-((x[:, None] - z[None]) ** 2) / 0.02).sum(axis=1)).tolist()))
    k = spark.createDataFrame(rows, "loi string, frame long, x_pos array<double>, profile array<double>")
    out = pipelines.motion(k, dt)
    assert out["traj"].select("band").distinct().count() == n - 1
    found = [(r.start_frame, r.frames) for r in out["cycles"].orderBy("run").collect()]
    assert len(found) == 3 and all(abs(s - e) <= 2 for (s, _), e in zip(found, (19, 69, 119)))
    assert out["rates"].first().rate == pytest.approx(1 / (50 * dt), rel=0.05)
    low = out["features"].agg(F.avg("contr_max")).first()[0]
    assert low == pytest.approx(-0.3, abs=0.06) and out["popping"].agg(F.max("pops")).first()[0] == 0


def test_files_fail_alone(spark):
    def analyse(f):
        if f == "bad":
            raise ValueError("broken")
        return spark.createDataFrame([(f, 1.0)], "path string, a double")

    df, failed = pipelines.each_file(["x/a.tif", "bad", "y/b.tif"], analyse, batch=lambda p: F.substring_index(p, "/", 1))
    assert sorted((r.path, r.batch) for r in df.collect()) == [("x/a.tif", "x"), ("y/b.tif", "y")] and failed == [("bad", "ValueError: broken")]
