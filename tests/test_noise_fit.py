"""1/f fits through windows and modes that are taken out one by one, against planted noise."""

from __future__ import annotations

import numpy as np
import pytest

from skyquilt.operators import noise_fit
from skyquilt.sources import fits as files


@pytest.mark.parametrize("share", [1.0, 0.6])
@pytest.mark.parametrize("truth", [(2.0, -1.5, 0.3), (0.5, -1.0, 1.0), (5.0, -2.2, 0.01)])
def test_exact_spectra_give_their_parameters(truth, share):
    rng = np.random.default_rng(1)
    mask = (rng.random(300) < share).astype(float)
    window = np.abs(np.fft.fft(mask)) ** 2 / 300**2
    f = noise_fit.frequencies(300, 0.5)
    a, i, c = truth
    found = noise_fit.fit_windowed(noise_fit.windowed(a * (f / 0.1) ** i + c, window), window, 0.5, 0.1)
    assert np.allclose(found[:3], truth, rtol=1e-5) and found[3] < 1e-12


def test_windowed_spectrum_is_what_masked_noise_has(spark):
    rng = np.random.default_rng(2)
    n, dt = 128, 0.5
    f = noise_fit.frequencies(n, dt)
    spectrum = 0.5 * (f / 0.1) ** -1.2 + 0.2
    mask = (rng.random(n) < 0.7).astype(float)
    rows = []
    for k in range(400):
        white = np.fft.fft(rng.normal(size=n))
        x = np.fft.ifft(white * np.sqrt(spectrum / (2 * dt))).real
        rows += [(k, t, float(x[t]) if mask[t] else None, float(mask[t])) for t in range(n)]
    df = spark.createDataFrame(rows, "k int, slot int, value double, mask double")
    out = noise_fit.window_power(df, ["k"], n, dt).groupBy("i").agg({"power": "avg", "window": "avg"}).orderBy("i").toPandas()
    want = noise_fit.windowed(spectrum, out["avg(window)"].to_numpy())
    assert np.abs(out["avg(power)"] / want - 1)[1:].mean() < 0.08 and np.abs(out["avg(power)"] / want - 1)[1:].max() < 0.35


def test_planted_modes_are_found_and_taken_out(spark):
    rng = np.random.default_rng(3)
    n, chans, dt = 400, 5, 0.5
    f = noise_fit.frequencies(n, dt)
    modes = np.linalg.qr(rng.normal(size=(chans, 2)))[0].T
    truth = [(4.0, -1.4), (0.6, -1.1)]
    rows = []
    for key in ("a", "b"):
        x = rng.normal(size=(chans, n)) * np.sqrt(0.02 / (2 * dt))
        for v, (amp, index) in zip(modes, truth):
            s = amp * (f / 0.1) ** index
            x += v[:, None] * np.fft.ifft(np.fft.fft(rng.normal(size=n)) * np.sqrt(s / (2 * dt))).real
        x[:, rng.random(n) < 0.1] = np.nan
        x[4, 8:] = np.nan if key == "b" else x[4, 8:]
        rows += [(key, c, t, None if np.isnan(x[c, t]) else float(x[c, t])) for c in range(chans) for t in range(n)]
    df = spark.createDataFrame(rows, "file string, chan int, t long, value double")
    vectors, fits, channels = noise_fit.measure_modes(files.stager(spark, "modes"), df, ["file"], n, 20, 2, dt, 0.1)
    found = {(r.file, r["mode"], r.chan): r.v for r in vectors.collect()}
    for m in range(2):
        assert abs(sum(found["a", m, c] * modes[m][c] for c in range(chans))) > 0.97
    for r in fits.where("file = 'a'").collect():
        amp, index = truth[r["mode"]]
        assert 0.5 * amp < r.amplitude < 2 * amp and abs(r["index"] - index) < 0.35
    left = {(r.file, r.chan): r for r in channels.collect()}
    assert len(left) == 10 and left["b", 4].var == noise_fit.NO_DATA
    assert all(r.var < 0.05 for (k, c), r in left.items() if k == "a")
