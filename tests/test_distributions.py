"""Tail probabilities, wavelet shapes and sheets against known values."""

import zipfile

import numpy as np
import pytest

from sparkloom.functions import distributions, images
from sparkloom.sources import files


def test_tails():
    assert distributions.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert distributions.t_two_sided(1.0, 1) == pytest.approx(0.5) and distributions.t_two_sided(0.0, 7) == pytest.approx(1.0)
    assert distributions.t_two_sided(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-5) and np.isnan(distributions.t_two_sided(float("nan"), 3))
    assert distributions.incomplete_beta(2, 3, 0.5) == pytest.approx(11 / 16)
    assert distributions.kolmogorov(1.358 / (100 + 0.12 + 0.11 / 100), 10_000) == pytest.approx(0.05, abs=1e-3) and distributions.kolmogorov(0.0, 5) == 1.0


@pytest.mark.parametrize("shape", ["gaussian", "half_gaussian", "binary"])
def test_every_wavelet_finds_the_bars(shape):
    img = np.zeros((40, 60))
    img[10:30, 20:23] = img[10:30, 36:39] = 1.0
    lengths, angles = np.arange(12.0, 21.0, 2.0), np.deg2rad([-60, 0, 60])
    score, n, t = images.best_wavelet(images.double_wavelets(img, lengths, angles, 6.0, 3.0 if shape == "binary" else 1.3, shape))
    assert lengths[n[20, 29]] == 16 and angles[t[20, 29]] == 0 and score[20, 29] == pytest.approx(score.max(), rel=1e-6)
    with pytest.raises(ValueError):
        images.double_wavelets(img, lengths, angles, 6.0, 1.3, "other")


def test_negative_centre_rejects_bars_two_lengths_apart():
    img = np.zeros((40, 60))
    for c in (13, 29, 45):
        img[10:30, c - 1 : c + 2] = 1.0
    one = images.double_wavelets(img, np.array([32.0]), np.array([0.0]), 6.0, 1.3)[0, 0, 20, 29]
    less = images.double_wavelets(img, np.array([32.0]), np.array([0.0]), 6.0, 1.3, "gaussian", True)[0, 0, 20, 29]
    assert one > 0.1 and less < 0.01


def test_sheet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b & c", 1.5, [1, 2]), (2, None, float("nan"), None)], "k int, t string, v double, a array<int>")
    files.export(df.coalesce(1), str(tmp_path / "t.xlsx"), "xlsx")
    with zipfile.ZipFile(tmp_path / "t.xlsx") as book:
        text = book.read("xl/worksheets/sheet1.xml").decode()
        assert book.testzip() is None and {"[Content_Types].xml", "xl/workbook.xml"} <= set(book.namelist())
    assert text.count("<row>") == 3 and "a&lt;b &amp; c" in text and "<v>1.5</v>" in text and "[1, 2]" in text and "nan" not in text
