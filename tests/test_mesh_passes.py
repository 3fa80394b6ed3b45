"""What strips hand to the second pass, and faces in outlines with and without a join."""

import numpy as np
import pyarrow as pa

from driftplane import catalog_mesh as C
from driftplane.operators import mesh, topology


def test_only_the_border_of_a_strip_is_open():
    p = np.random.default_rng(4).random((400, 2))
    at = np.concatenate([np.zeros((400, 3)), p], 1)
    mine = (p[:, 0] > 0.2) & (p[:, 0] < 0.8)
    t = mesh.delaunay(p)
    t = t[mine[t].any(1) & (t != 7).all(1)]
    got = mesh._marked(pa.table({"topology_id": [1] * 400}), ("topology_id",), at, t, mine).to_pydict()
    sides: dict = {}
    for f in t.tolist():
        for i in range(3):
            sides.setdefault(tuple(sorted((f[i], f[(i + 1) % 3]))), []).append(1)
    assert sum(bin(b).count("1") for b in got["_sides"]) == sum(len(v) == 1 for v in sides.values()) < len(sides) / 4
    assert sum(bin(b).count("1") for b in got["_foreign"]) == (~mine[t]).sum()
    lonely = [u for u, a in zip(got["u0"], got["_alone"], strict=True) if a]
    assert lonely == sorted(at[np.setdiff1d(np.flatnonzero(mine), t), 3].tolist(), key=at[:, 3].tolist().index) and (at[7, 3] in lonely) == bool(mine[7])


def test_faces_are_the_same_by_row_and_by_join(spark):
    sections = C._sections(spark, "/root/testdata/sf0.001").where("topology_id < 2")
    rows = lambda few: sorted(topology.networks(sections, few=few).select("topology_id", "face", "region").collect())
    assert rows(0) == rows(64) and rows(0)
