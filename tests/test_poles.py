"""Fits of two and three plates: recovered rotations, covariance, confidence regions."""

import math

import numpy as np
import pytest


from driftplane.operators import hellinger

TRUE = {2: (40.0, -30.0, 12.0), 3: (-20.0, 60.0, 25.0)}
GUESS = {2: (38.0, -28.0, 11.0), 3: (-18.0, 62.0, 24.0)}


def picks(noise=0.0, per=8, seed=0, three=True):
    """(plate, segment, lat, lon): circles in many directions, seen from the plates."""
    r = np.random.default_rng(seed)
    turns = {1: np.eye(3)} | {p: hellinger._matrix(*x) for p, x in TRUE.items()}
    pairs = [(1, 2), (1, 3), (2, 3)] if three else [(1, 2)]
    out = []
    for s in range(6 * len(pairs)):
        a, b = pairs[s % len(pairs)]
        n = r.normal(size=3)
        n /= np.linalg.norm(n)
        e = np.linalg.svd(n[None])[2][1:]
        for k in range(per):
            t = r.uniform(0, 1.2)
            for p in (a, b):
                x = math.cos(t) * e[0] + math.sin(t) * e[1] + noise * r.normal(size=3)
                x = turns[p].T @ (x / np.linalg.norm(x))
                out.append((p, s, math.degrees(math.asin(x[2])), math.degrees(math.atan2(x[1], x[0]))))
    return out


def scattered(rows, sigma=1.0):
    p, s, la, lo = zip(*rows, strict=True)
    return hellinger.scatter_of(la, lo, p, s, np.full(len(p), sigma))


def test_three_plates_are_recovered(spark):
    rows = [("a", *r, 1.0) for r in picks()] + [("b", *r, 1.0) for r in picks(seed=1)] + [("b", 1, 0, None, 1.0, 1.0), ("b", 1, 0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "key string, plate int, segment int, lat double, lon double, sigma double").repartition(5)
    got = {(r.key, r.moving, r.fixed): r for r in hellinger.fit_circuits(df, GUESS).collect()}
    assert set(got) == {(k, *p) for k in "ab" for p in ((2, 1), (3, 1), (3, 2))}
    closed = hellinger.pole(hellinger._matrix(*TRUE[2]).T @ hellinger._matrix(*TRUE[3]))
    for k in "ab":
        for pair, want in (((2, 1), TRUE[2]), ((3, 1), TRUE[3]), ((3, 2), closed)):
            r = got[k, *pair]
            assert (r.lat, r.lon, r.angle) == pytest.approx(want, abs=1e-6) and r.misfit < 1e-12
    assert got["a", 2, 1].picks == 288 and got["a", 2, 1].segments == 18


def test_gradient_and_matrix_by_differences():
    s = scattered(picks(noise=1e-6))
    turns = {p: hellinger.turned(np.array([0.02, -0.01, 0.03])) @ hellinger._matrix(*x) for p, x in TRUE.items()}
    moved = lambda u: s.misfit({p: hellinger.turned(u[3 * i : 3 * i + 3]) @ turns[p] for i, p in enumerate(s.free)})
    g, _ = s.normal(turns)
    unit = np.eye(6) * 1e-6
    assert np.allclose([(moved(u) - moved(-u)) / 4e-6 for u in unit], g, rtol=1e-5, atol=1e-7)
    # at the fit the matrix is half the second derivative of the misfit
    turns, _ = s.fit(GUESS)
    _, h = s.normal(turns)
    unit = np.eye(6) * 1e-4
    second = [[(moved(u + v) - moved(u - v) - moved(v - u) + moved(-u - v)) / 8e-8 for v in unit] for u in unit]
    assert np.allclose(second, h, rtol=1e-3, atol=1e-3 * np.abs(h).max())


def test_covariance_is_that_of_repeated_fits():
    noise, errors = 1e-3, []
    for seed in range(120):
        r = np.random.default_rng(1000 + seed)
        rows = [(p, s, la + math.degrees(noise) * r.normal(), lo + math.degrees(noise) * r.normal() / max(0.1, math.cos(math.radians(la)))) for p, s, la, lo in picks(three=False, per=6)]
        s = scattered(rows, noise)
        turns, _ = s.fit(GUESS, grid=1)
        d = turns[2] @ hellinger._matrix(*TRUE[2]).T
        errors.append([d[2, 1] - d[1, 2], d[0, 2] - d[2, 0], d[1, 0] - d[0, 1]])
    seen = np.cov(np.array(errors).T / 2)
    said = np.linalg.inv(s.normal(turns)[1])
    assert np.allclose(np.diag(seen), np.diag(said), rtol=0.5)


def test_confidence_region(spark):
    rows = [("a", *r, 0.01) for r in picks(noise=1e-3)]
    df = spark.createDataFrame(rows, "key string, plate int, segment int, lat double, lon double, sigma double")
    fits = hellinger.fit_circuits(df, GUESS).cache()
    region = hellinger.confidence_region(fits, points=50).collect()
    assert len(region) == 150
    for f in fits.collect():
        home, inv = hellinger._matrix(f.lat, f.lon, f.angle), np.linalg.inv(np.array(f.covariance).reshape(3, 3))
        for r in region:
            if (r.moving, r.fixed) == (f.moving, f.fixed):
                d = hellinger._matrix(r.lat, r.lon, r.angle) @ home.T
                la, lo, an = hellinger.pole(d)
                u = np.radians(an) * np.array([math.cos(math.radians(la)) * math.cos(math.radians(lo)), math.cos(math.radians(la)) * math.sin(math.radians(lo)), math.sin(math.radians(la))])
                assert u @ inv @ u == pytest.approx(hellinger.quantile(0.95), rel=1e-4)
    assert hellinger.quantile(0.95) == pytest.approx(7.8147, abs=1e-3) and hellinger.quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert all(f.kappa > 1 for f in fits.collect())


def test_poles_of_matrices():
    for la, lo, an in ((10, 20, 30), (-80, 170, 179.9), (0, 0, 180.0), (45, -45, 1e-5)):
        got = hellinger.pole(hellinger._matrix(la, lo, an))
        assert np.allclose(hellinger._matrix(*got), hellinger._matrix(la, lo, an), atol=1e-9)
    assert hellinger.pole(np.eye(3)) == (90.0, 0.0, 0.0)


def test_empty(spark):
    df = spark.createDataFrame([], "key string, plate int, segment int, lat double, lon double, sigma double")
    assert hellinger.fit_circuits(df, GUESS).count() == 0 and hellinger.confidence_region(hellinger.fit_circuits(df, GUESS)).count() == 0
