"""Cutting lines and polygon outlines where they cross a polygon, in numpy, a feature at a time."""

from __future__ import annotations

import numpy as np

#: Nearer than this to an outline is on it; turns of the point that is outside.
ON = 1e-9
_ASIDE = np.array([0.00123, -0.00371, 0.00289])


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def edges(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the arcs of closed rings."""
    return np.vstack(rings), np.vstack([np.roll(r, -1, axis=0) for r in rings])


def meetings(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(arc of the first set, arc of the second, point) where arcs cross.  An end on the other
    arc's plane counts as on its positive side, so passing a corner is one crossing."""
    m, n = np.cross(a, b), np.cross(c, d)
    i, j = np.nonzero(((m @ c.T >= 0) != (m @ d.T >= 0)) & ((n @ a.T >= 0) != (n @ b.T >= 0)).T)
    p = np.cross(m[i], n[j])
    size = np.linalg.norm(p, axis=1)
    i, j, p, size = i[size > 0], j[size > 0], p[size > 0], size[size > 0]
    p = p / size[:, None]
    p *= np.where((p * (a[i] + b[i])).sum(1) >= 0, 1.0, -1.0)[:, None]
    on = (p * (c[j] + d[j])).sum(1) > 0
    return i[on], j[on], p[on]


def to_arcs(p: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Angular distance of a point to each arc."""
    n = np.cross(c, d)
    size = np.linalg.norm(n, axis=1)
    ends = np.arccos(np.clip(np.maximum(c @ p, d @ p), -1, 1))
    inside = (np.cross(n, c) @ p >= 0) & (np.cross(d, n) @ p >= 0) & (size > 1e-12)
    return np.where(inside, np.arcsin(np.clip(np.abs(n @ p) / np.maximum(size, 1e-300), 0, 1)), ends)


def holds(rings: list[np.ndarray], p: np.ndarray) -> bool:
    """Whether a polygon holds a point; its outlines belong to it."""
    c, d = edges(rings)
    if (to_arcs(p, c, d) < ON).any():
        return True
    middle = rings[0].sum(0)
    out = unit(-(unit(middle) if np.linalg.norm(middle) > 1e-12 else rings[0][0]) + _ASIDE)
    return len(meetings(out[None], p[None], c, d)[0]) % 2 == 1


def cut(line: np.ndarray, closed: bool, rings: list[np.ndarray]) -> list[tuple[bool, bool, np.ndarray]]:
    """(inside, whole, points) of the parts of a line, or outline if ``closed``, in a polygon and
    outside.  Crossing points belong to both parts.  Without a crossing the line is one whole
    part; the part of an outline that passes its first point is one."""
    if len(line) < 2:
        return [(holds(rings, line[0]), True, line)] if len(line) else []
    path = np.vstack([line, line[:1]]) if closed else line
    i, _, p = meetings(path[:-1], path[1:], *edges(rings))
    if not len(i):
        return [(holds(rings, line[0]), True, line)]
    along = np.arccos(np.clip((path[i] * p).sum(1), -1, 1))
    order = np.lexsort((along, i))
    parts, here = [], [path[0]]
    at = 0
    for k in order.tolist():
        here += list(path[at + 1 : i[k] + 1])
        at = max(at, int(i[k]))
        parts.append(np.array([*here, p[k]]))
        here = [p[k]]
    parts.append(np.array([*here, *path[at + 1 :]]))
    if closed:  # the last part goes on with the first
        parts[0] = np.vstack([parts.pop(), parts[0][1:]])
    out = []
    for x in parts:
        keep = np.ones(len(x), bool)
        keep[1:] = np.abs(x[1:] - x[:-1]).sum(1) > 1e-12
        x = x[keep]
        if len(x) > 1:
            step = int(np.argmin((x[:-1] * x[1:]).sum(1)))  # the middle of its longest arc tells
            out.append((holds(rings, unit(x[step] + x[step + 1])), False, x))
    return out


def length(line: np.ndarray) -> float:
    return float(np.arccos(np.clip((line[:-1] * line[1:]).sum(1), -1, 1)).sum())


def cascade(gtype: str, rings: list[np.ndarray], polygons: list[tuple[object, list[np.ndarray]]]) -> list[tuple[object, str, list[np.ndarray]]]:
    """(plate or None, kind, rings) of a geometry's parts: each polygon in turn takes what is
    inside it, and the remainder goes on to the next.  A polygon that is cut becomes lines; one
    that is not stays whole, holes included.  Points are taken one by one."""
    if gtype in ("point", "multipoint"):
        left, out = np.vstack(rings) if rings else np.zeros((0, 3)), []
        for name, shape in polygons:
            inside = np.array([holds(shape, p) for p in left], bool)
            if inside.any():
                out.append((name, gtype, [left[inside]]))
                left = left[~inside]
        return out + ([(None, gtype, [left])] if len(left) else [])
    start = [rings] if gtype == "polygon" else [[r] for r in rings]
    rest = [((i,), gtype, part) for i, part in enumerate(start)]  # where along the geometry, kind, rings
    out = []
    for name, shape in polygons:
        after = []
        for at, kind, part in rest:
            for n, (inside, whole, line) in enumerate(cut(part[0], kind == "polygon", shape)):
                piece = ((*at, n), kind, part) if whole else ((*at, n), "polyline", [line])
                if inside:
                    out.append((name, *piece))
                else:
                    after.append(piece)
        rest = after
    return [(name, kind, part) for name, _, kind, part in sorted(out + [(None, *x) for x in rest], key=lambda x: x[1])]
