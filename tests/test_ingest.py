"""Election tables of several states, overlays of many vertices, and filling by scan lines."""

import json
import math
import os
import random
import resource

import numpy as np
import pytest

from wardline import driver_files
from wardline.operators import drawing, spatial
from wardline.sources import geojson, ingest


def test_tables_of_several_states(spark, tmp_path):
    (tmp_path / "va.tab").write_text('ID\tD\tR\tTOT\n"1"\t10\t7\t20\n2\tNA\t3.9\t9\n1\t11\tx\t21\n9ZZ\t1\t1\t1\n\n')
    os.mkdir(tmp_path / "wv.tab")
    for i in range(3):  # parts of a table, each below its header
        (tmp_path / "wv.tab" / f"part-{i}.txt").write_text(f"R\tcounty\tward\tD\n{i}\tc\t{i}\t{i * 2}\n")
    feature = lambda **p: {"type": "Feature", "geometry": None, "properties": p}
    (tmp_path / "vt.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(G="a", DEM=5, REP="", LIB=2), feature(G="b", DEM=None, REP="4", LIB=" ")]}))
    (tmp_path / "none.tab").write_text("ID\tD\n1\t1\n")
    meta = {
        "va": {"party_data": {"dem_keys": ["D", "D2"], "rep_keys": ["R"], "green_keys": []}, "ele_id": "ID", "geo_id": "GEO", "pop_key": None, "non_precinct_ids": ["ZZ"]},
        "wv": {"party_data": {"dem_keys": ["D"], "rep_keys": ["R"], "other_keys": ["gone"]}, "ele_id": ["county", "ward"], "geo_id": ["a", "b"]},
        "vt": {"party_data": {"dem_keys": ["DEM"], "rep_keys": ["REP"], "libertarian_keys": ["LIB"], "who_keys": ["X"]}, "ele_id": ["G"], "geo_id": "G", "pop_key": "P"},
    }
    os.mkdir(tmp_path / "meta")
    (tmp_path / "meta" / "states.txt").write_text(json.dumps(meta))
    roles = ingest.role_map(spark, str(tmp_path / "meta"))
    assert {r.state: (r.geo_ids, r.pop_keys) for r in roles.collect()} == {"va": (["GEO"], []), "wv": (["a", "b"], []), "vt": (["G"], ["P"])}
    files = spark.createDataFrame([("va.tab", "va"), ("wv.tab", "wv"), ("vt.json", "vt"), ("missing.tab", "xx")], "file string, state string")
    got = {tuple(r) for r in ingest.read_elections(spark, str(tmp_path), files, roles).collect()}
    assert got == {
        ("va", "1", "dem", 11), ("va", "1", "rep", 7), ("va", "2", "rep", 3), *[("wv", f"c{i}", "rep", i) for i in range(3)], *[("wv", f"c{i}", "dem", i * 2) for i in range(3)],
        ("vt", "a", "dem", 5), ("vt", "a", "lib", 2), ("vt", "b", "rep", 4),
    }


def star(rng, n, cx, cy):
    turn = np.sort(np.array([rng.random() for _ in range(n)])) * 2 * math.pi
    r = np.array([rng.uniform(3, 5) for _ in range(n)])
    return np.column_stack((cx + r * np.cos(turn), cy + r * np.sin(turn)))


def shore(rng, n, cx, cy):
    """A border of many short edges."""
    turn = np.sort(np.array([rng.random() for _ in range(n)])) * 2 * math.pi
    r = 4 + 0.5 * np.sin(7 * turn) + np.array([rng.uniform(-1e-3, 1e-3) for _ in range(n)])
    return np.column_stack((cx + r * np.cos(turn), cy + r * np.sin(turn)))


def inside(rings, x, y):
    out = np.zeros(len(x), bool)
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, np.roll(r, -1, axis=0)):
            if y1 != y2:
                out ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_overlap_of_jagged_shapes_by_sampling(seed):
    rng = random.Random(seed)
    a, b = [star(rng, 30, 0, 0), star(rng, 9, 0.3, 0) / 4], [star(rng, 40, 2, 1)]
    side = np.linspace(-8, 8, 900) + 1e-4
    x, y = (v.ravel() for v in np.meshgrid(side, side))
    want = (inside(a, x, y) & inside(b, x, y)).sum() * (side[1] - side[0]) ** 2
    assert spatial.overlap_area(a, b) == pytest.approx(want, rel=0.01)
    assert spatial.overlap_area(a, b) == pytest.approx(spatial.overlap_area(b, [r[::-1] for r in a]), rel=1e-12)


def test_overlap_of_twenty_thousand_vertices_in_little_memory():
    rng = random.Random(9)
    ring = shore(rng, 20_000, 0, 0)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    x, y = ring[:, 0], ring[:, 1]
    own = abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)
    assert spatial.overlap_area([ring], [ring[::-1]]) == pytest.approx(own, rel=1e-9)
    box = np.array([(-6.0, -6.0), (0.0, -6.0), (0.0, 6.0), (-6.0, 6.0)])
    parts = spatial.overlap_area([ring], [box]) + spatial.overlap_area([ring], [box + [6.0, 0.0]])
    assert parts == pytest.approx(own, rel=1e-9)
    assert 0 < spatial.overlap_area([ring], [shore(rng, 20_000, 1, 0)]) < own
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
    assert spatial.overlap_area([], [ring]) == 0.0 and spatial.overlap_area([ring], [ring + [100.0, 0.0]]) == 0.0


def test_spans_are_the_pixels_within(spark):
    rng = random.Random(2)
    shapes = [(i, [star(rng, 25, 6, 6) * 2, star(rng, 7, 6.0, 6.0) / 5 + [9.6, 9.6]]) for i in range(3)]
    point = lambda r: [(float(x), float(y)) for x, y in r]
    df = spark.createDataFrame([(i, point(h), [point(x) for x in rest]) for i, (h, *rest) in shapes] + [(9, [], None)], "id int, hull array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>")
    got = {(r.id, r.row, x) for r in drawing.spans(df).collect() for x in range(r.x0, r.x1)}
    want = set()
    for i, rings in shapes:
        x, y = (v.ravel() for v in np.meshgrid(np.arange(-5, 40), np.arange(-5, 40)))
        want |= {(i, int(b), int(a)) for a, b, k in zip(x, y, inside(rings, x + 0.5, y + 0.5)) if k}
    assert got == want


def test_shapes_in_lines_or_files_make_the_same_collections(spark, tmp_path):
    shapes = {"vt_1": ['{"a":1}', '{"a":2}'], "vt_2": ['{"a":3}'], "ny_3": ['{"a":4}']}
    for name, texts in shapes.items():
        (tmp_path / "lines" / name).mkdir(parents=True)
        (tmp_path / "lines" / name / "shapes.txt").write_text("\n".join([*texts, " ", ""]))
        for i, t in enumerate(texts):
            (tmp_path / "files" / name).mkdir(parents=True, exist_ok=True)
            (tmp_path / "files" / name / f"{i}.txt").write_text(t)
    got = [sorted(map(tuple, geojson.combine_shapes(spark, f"{tmp_path}/{n}/*", **o).collect())) for n, o in (("lines", {"lines": True}), ("files", {}))]
    assert got[0] == got[1] == [(s, '{"type":"FeatureCollection","features":[' + inner + "]}") for s, inner in (("ny", '{"a":4}'), ("vt", '{"a":1},{"a":2},{"a":3}'))]


def test_folders_of_shapes_do_not_grow_with_the_shapes(spark, tmp_path, monkeypatch):
    rows = spark.range(600).selectExpr("id s_suppkey", "cast(id % 25 as int) s_nationkey", "0.5D s_acctbal")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(driver_files, "shared_path", lambda spark, name: f"{tmp_path}/{name}")
    got = driver_files.combined_shapes(spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) == 600 and sum(r.ids for r in got) == 600 * 599 // 2 and len(got) == 25
    assert len([p for p in (tmp_path / "shapes").iterdir() if p.is_dir()]) <= 8 * 25
