"""Pole fitting: the rotations that bring fracture-zone and isochron picks of plates into line.

Picks lie on segments of great circles; after the plates are rotated to the first one's frame,
a segment's picks of its two plates lie on one circle.  How far they are from it is the least
eigenvalue of their weighted scatter, so a fit needs no picks, only the scatter of every
segment and plate: six sums, added up in Spark from any number of picks.  What is fitted
together (a key) is a few rows a segment.

Two plates have one rotation, three have two, fitted together over the segments of all three
pairs; the third pair's rotation closes the circuit.  The step is Gauss and Newton's, damped,
with the circles' normals eliminated; the same matrix, inverted, is the covariance of the
rotations for the standard errors given with the picks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..functions import sphere as S

Pole = tuple[float, float, float]
_SUMS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _matrix(lat: float, lon: float, angle: float) -> np.ndarray:
    p, m, t = np.radians([lat, lon, angle])
    return turned(np.array([np.cos(p) * np.cos(m), np.cos(p) * np.sin(m), np.sin(p)]) * t)


def _cross(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def turned(u: np.ndarray) -> np.ndarray:
    """The rotation matrix of a rotation vector in radians."""
    t = float(np.linalg.norm(u))
    if t < 1e-15:
        return np.eye(3)
    k = _cross(u / t)
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * (k @ k)


def pole(r: np.ndarray) -> Pole:
    """(lat, lon, angle) in degrees of a rotation matrix, the angle from 0 to 180."""
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    s, c = float(np.linalg.norm(v)) / 2, (float(np.trace(r)) - 1) / 2
    if s < 1e-12 and c > 0:
        return 90.0, 0.0, 0.0
    if s < 1e-9:  # half a turn: the axis is what the rotation leaves alone
        v = np.linalg.eigh((r + r.T) / 2)[1][:, 2]
    v = v / np.linalg.norm(v)
    return float(np.degrees(np.arcsin(np.clip(v[2], -1, 1)))), float(np.degrees(np.arctan2(v[1], v[0]))), float(np.degrees(np.arctan2(s, c)))


class Scatter:
    """The scatter matrices (3, 3) of segments, by (segment, plate)."""

    def __init__(self, parts: dict[tuple, np.ndarray]):
        self.plates = sorted({p for _, p in parts})
        self.free = self.plates[1:]
        self.segments: dict = {}
        for (s, p), m in sorted(parts.items(), key=lambda x: (str(x[0][0]), x[0][1])):
            self.segments.setdefault(s, []).append((p, m))

    def _there(self, turns: dict[int, np.ndarray]):
        for parts in self.segments.values():
            yield [(p, turns[p] @ m @ turns[p].T if p in turns else m) for p, m in parts]

    def misfit(self, turns: dict[int, np.ndarray]) -> float:
        return float(sum(np.linalg.eigvalsh(sum(m for _, m in parts))[0] for parts in self._there(turns)))

    def normal(self, turns: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Half the gradient of the misfit by small turns of each free plate, and the matrix of
        the least squares with the circles' normals eliminated."""
        n = 3 * len(self.free)
        g, h = np.zeros(n), np.zeros((n, n))
        at = {p: slice(3 * i, 3 * i + 3) for i, p in enumerate(self.free)}
        for parts in self._there(turns):
            whole = sum(m for _, m in parts)
            vectors = np.linalg.eigh(whole)[1]
            eta, e = vectors[:, 0], vectors[:, 1:]
            k = _cross(eta)
            back = np.linalg.pinv(e.T @ whole @ e)
            b = {p: -k @ m @ e for p, m in parts if p in at}
            for p, m in parts:
                if p in at:
                    g[at[p]] += np.cross(m @ eta, eta)
                    h[at[p], at[p]] += k @ m @ k.T
                    for q in b:
                        h[at[p], at[q]] -= b[p] @ back @ b[q].T
        return g, h

    def fit(self, guesses: dict[int, Pole], radius: float = 5.0, grid: int = 5, rounds: int = 200) -> tuple[dict[int, np.ndarray], float]:
        """Rotations of the free plates to the first one, and their misfit: from the best of a
        grid about each guess, by damped steps."""
        turns = {p: _matrix(*guesses[p]) for p in self.free}
        side = np.linspace(-radius, radius, grid)
        for p in self.free:
            some = [_matrix(*(np.array(guesses[p]) + (a, b, c))) for a in side for b in side for c in side]
            turns[p] = min(some, key=lambda r, p=p: self.misfit(turns | {p: r}))
        best, damp = self.misfit(turns), 1e-3
        for _ in range(rounds):
            g, h = self.normal(turns)
            step = -np.linalg.lstsq(h + damp * np.diag(np.maximum(np.diag(h), 1e-300)), g, rcond=None)[0]
            tried = {p: turned(step[3 * i : 3 * i + 3]) @ turns[p] for i, p in enumerate(self.free)}
            value = self.misfit(tried)
            if value < best:
                turns, best, damp = tried, value, max(damp / 5, 1e-14)
            else:
                damp *= 10
            if np.linalg.norm(step) < 1e-13 or damp > 1e9:
                break
        return turns, best


def scatter_of(lat, lon, plate, segment, sigma) -> Scatter:
    p, m = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    y = np.stack([np.cos(p) * np.cos(m), np.cos(p) * np.sin(m), np.sin(p)], 1) / np.asarray(sigma, float)[:, None]
    plate, segment = np.asarray(plate), np.asarray(segment)
    return Scatter({(s, int(q)): y[(segment == s) & (plate == q)].T @ y[(segment == s) & (plate == q)] for s, q in set(zip(segment.tolist(), plate.tolist(), strict=True))})


def fit(lat, lon, moving, segment, sigma, guess: Pole, radius: float = 5.0, grid: int = 5) -> tuple[np.ndarray, float]:
    """(lat, lon, angle) and misfit of two plates' picks."""
    turns, value = scatter_of(lat, lon, np.where(np.asarray(moving, bool), 2, 1), segment, sigma).fit({2: guess}, radius, grid)
    return np.array(pole(turns[2])), value


def scatter(picks: DataFrame, *, key: str = "key") -> DataFrame:
    """(key, segment, plate, picks, xx ... zz) of picks (key, segment, plate, lat, lon, sigma):
    sums over rows, wherever they are.  Picks without a place or a positive sigma do not count."""
    # the explode of one keeps the optimiser from working a place out anew for each sum
    rows = picks.select(key, "segment", "plate", "sigma", F.explode(F.array(S.from_lat_lon("lat", "lon"))).alias("_v")).where("_v.x is not null and _v.z is not null and sigma > 0")
    return rows.groupBy(key, "segment", "plate").agg(F.count("*").alias("picks"), *(F.sum(F.col(f"_v.{s[0]}") * F.col(f"_v.{s[1]}") / (F.col("sigma") * F.col("sigma"))).alias(s) for s in _SUMS))


FIT = "{key} {kind}, moving int, fixed int, lat double, lon double, angle double, misfit double, picks long, segments int, kappa double, covariance array<double>"


def fit_circuits(picks: DataFrame, guesses: dict[int, Pole], *, key: str = "key", radius: float = 5.0, grid: int = 5) -> DataFrame:
    """Fitted rotations of every key, from picks (key, plate, segment, lat, lon, sigma).

    Plates are numbers; the least is the frame, ``guesses`` has the others'.  A key has a row
    for each pair (moving, fixed): those of the frame are fitted, the pair of the other two is
    put together from them.  ``covariance`` is of the rotation vector in radians that turns a
    fitted rotation, in the frame of ``fixed``, row by row; ``kappa`` is the estimate of how far
    the given sigma are too large (above one) or small; null where no degrees are free."""

    def run(k, frame):
        import pandas as pd

        parts = {}
        for r in frame.itertuples():
            xx, xy, xz, yy, yz, zz = (getattr(r, s) for s in _SUMS)
            parts[r.segment, int(r.plate)] = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]])
        s, n = Scatter(parts), int(frame["picks"].sum())
        turns, value = s.fit(guesses, radius, grid)
        cov = np.linalg.pinv(s.normal(turns)[1])
        spare = n - 2 * len(s.segments) - 3 * len(s.free)
        kappa = spare / value if spare > 0 and value > 0 else None
        block = lambda i, j: cov[3 * i : 3 * i + 3, 3 * j : 3 * j + 3]
        rows = [(p, s.plates[0], turns[p], block(i, i)) for i, p in enumerate(s.free)]
        for j in range(len(s.free)):
            for i in range(j):
                home = turns[s.free[i]].T
                spread = block(j, j) + block(i, i) - block(i, j) - block(j, i)
                rows.append((s.free[j], s.free[i], home @ turns[s.free[j]], home @ spread @ home.T))
        out = [(k[0], m, f, *pole(r), value, n, len(s.segments), kappa, c.ravel().tolist()) for m, f, r, c in rows]
        return pd.DataFrame(out, columns=[key, "moving", "fixed", "lat", "lon", "angle", "misfit", "picks", "segments", "kappa", "covariance"])

    sums = scatter(picks, key=key)
    return sums.groupBy(key).applyInPandas(run, FIT.format(key=key, kind=dict(sums.dtypes)[key]))


def fit_poles(picks: DataFrame, guess: Pole, *, key: str = "key", **options) -> DataFrame:
    """(key as text, lat, lon, angle, misfit, picks): one fitted pole a key, from rows (key, lat,
    lon, moving, segment, sigma)."""
    two = picks.withColumn("plate", F.when(F.col("moving"), 2).otherwise(1))
    return fit_circuits(two, {2: guess}, key=key, **options).select(F.col(key).cast("string").alias("key"), "lat", "lon", "angle", "misfit", F.col("picks").cast("int").alias("picks"))


def quantile(level: float, degrees: int = 3) -> float:
    """The value that a chi-square variable of 1, 2 or 3 degrees stays below with probability
    ``level``, by bisection."""
    below = {1: lambda x: math.erf(math.sqrt(x / 2)), 2: lambda x: 1 - math.exp(-x / 2), 3: lambda x: math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2)}[degrees]
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < level else (lo, mid)
    return lo


def _root(c: Column) -> list[list[Column]]:
    """The lower triangle whose product with its transpose is a covariance of nine numbers."""
    at = lambda i, j: F.element_at(c, 3 * i + j + 1)
    pos = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    l00 = pos(at(0, 0))
    l10, l20 = over(at(1, 0), l00), over(at(2, 0), l00)
    l11 = pos(at(1, 1) - l10 * l10)
    l21 = over(at(2, 1) - l20 * l10, l11)
    return [[l00], [l10, l11], [l20, l21, pos(at(2, 2) - l20 * l20 - l21 * l21)]]


def confidence_region(fits: DataFrame, *, level: float = 0.95, points: int = 200, key: str = "key") -> DataFrame:
    """(key, moving, fixed, nth, lat, lon, angle): rotations on the surface of the region that
    holds the true one with probability ``level``, spread evenly in all directions."""
    turn = math.pi * (3 - math.sqrt(5))
    nth = F.col("nth")
    z = 1 - 2 * (nth + 0.5) / points
    flat = F.sqrt(1 - z * z)
    way = [flat * F.cos(nth * turn), flat * F.sin(nth * turn), z]
    size = math.sqrt(quantile(level))
    u = [size * sum(x * w for x, w in zip(row, way, strict=False)) for row in _root(F.col("covariance"))]
    rows = fits.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("_u", S.vector(*u))
    axis = S.from_lat_lon("lat", "lon")
    near = F.when(S.norm(F.col("_u")) > 0, Q.from_axis(S.normalise(F.col("_u")), S.norm(F.col("_u")))).otherwise(Q.from_axis(axis, F.lit(0.0)))
    q = rows.withColumn("_q", Q.shortest(Q.multiply(near, Q.from_axis(axis, F.radians("angle")))))
    a = Q.axis(F.col("_q"))
    return q.select(key, "moving", "fixed", "nth", S.lat(a).alias("lat"), S.lon(a).alias("lon"), F.degrees(Q.angle(F.col("_q"))).alias("angle"))
