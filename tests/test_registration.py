import numpy as np

from geoloom.operators import registration as P


def _scene(n, seed=3):
    rng = np.random.default_rng(seed)
    wave = np.fft.fft2(rng.normal(size=(n, n)))
    fy, fx = np.meshgrid(np.fft.fftfreq(n), np.fft.fftfreq(n), indexing="ij")
    return wave * np.exp(-60 * (fy**2 + fx**2)), fy, fx


def test_known_shifts_to_a_twentieth():
    wave, fy, fx = _scene(64)
    a = np.fft.ifft2(wave).real
    for dy, dx in ((0.0, 0.0), (1.25, -0.4), (-2.0, 0.55), (0.05, 3.1)):
        b = np.fft.ifft2(wave * np.exp(2j * np.pi * (fy * dy + fx * dx))).real  # b moved by (dy, dx) is a
        y, x = P.shift_of(a, b)
        assert abs(y - dy) < 0.051 and abs(x - dx) < 0.051
    assert P.peak_ratio(a, a) > 3 > P.peak_ratio(a, np.random.default_rng(1).normal(size=a.shape))


def test_windows_and_medians(spark):
    wave, fy, fx = _scene(64)
    a, b = np.fft.ifft2(wave).real, np.fft.ifft2(wave * np.exp(2j * np.pi * (fy * 0.5 - fx * 0.25))).real
    rows = [(1, r, c, float(a[r, c]), float(b[r, c]), not (r < 32 and c < 32 and (r + c) % 2)) for r in range(64) for c in range(64)]
    df = spark.createDataFrame(rows, "obs int, r int, c int, ref double, v double, ok boolean")
    found = P.window_shifts(df, 64, 70, 32)
    assert found.count() == 3  # half of the first window is not valid
    one = P.registration(found).first()
    assert one.n_windows == 3 and abs(one.dy - 0.5) < 0.11 and abs(one.dx + 0.25) < 0.11 and one.residual < 0.2 and one.peak > 3


def test_shifts_of_cells(spark):
    df = spark.createDataFrame([(1, r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "obs int, r int, c int, v double")
    moved = {(r.r, r.c): r.v for r in P.shifted(df, 0.5, 0.0, 4).collect()}
    assert moved == {(r, c): 10 * r + c - 5.0 for r in range(1, 4) for c in range(4)}
    near = {(r.r, r.c): r.v for r in P.shifted(df, 1.0, -1.0, 4, True, -1.0).collect()}
    assert near[1, 0] == 1.0 and near[0, 0] == -1.0 and near[3, 3] == -1.0 and len(near) == 16
