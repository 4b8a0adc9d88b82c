import json
import random

import numpy as np
from pyspark.sql import functions as F

from pagequire.operators import documents


def test_fingerprints_of_documents(spark):
    base = {"b": [{"y": 1, "x": {"q": None, "pixels": "p"}}], "a": "é", "mask": "m"}
    turned = {"mask": "other", "a": "é", "b": [{"x": {"pixels": "", "q": None}, "y": 1}]}
    rows = [json.dumps(base), json.dumps(turned, ensure_ascii=False, indent=2), json.dumps(base | {"a": "e"}), json.dumps(base | {"mask": None}), json.dumps(base | {"b": [{"y": 2, "x": {"q": None, "pixels": "p"}}]}), None, "no json", "[" * 10_000, ""]
    out = [r.f for r in spark.createDataFrame(list(enumerate(rows)), "i int, d string").coalesce(1).select("i", documents.document_fingerprint(F.col("d")).alias("f")).orderBy("i").collect()]
    assert out[0] == out[1] and out[5] is None and len({out[0], *out[2:]}) == 8


def test_signatures_of_states(spark):
    rows = [(1, {"b": (None, 50), "a": (False, None), "10": (True, 0)}), (2, {}), (3, None), (4, {"x": None})]
    frame = spark.createDataFrame(rows, "i int, s map<string,struct<visible:boolean,opacity:int>>")
    assert {r.i: r.g for r in frame.select("i", documents.state_signature(F.col("s")).alias("g")).collect()} == {1: "10:true:0|a:false:100|b:true:50", 2: "", 3: "", 4: "x:true:100"}


def test_warps_carry_corners_to_corners(spark):
    r = random.Random(4)
    quads = [[(r.uniform(-20, 20), r.uniform(-20, 20)), (r.uniform(80, 120), r.uniform(-20, 20)), (r.uniform(80, 120), r.uniform(80, 120)), (r.uniform(-20, 20), r.uniform(80, 120))] for _ in range(20)]
    points = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.3, 0.6), (-0.2, 1.4)]
    rows = [(i, *[c for p in q for c in p], u, v) for i, q in enumerate(quads) for u, v in points]
    names = "x0 y0 x1 y1 x2 y2 x3 y3".split()
    frame = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} double" for n in names) + ", u double, v double")
    x, y = documents.projective({k: (F.col(f"x{j}"), F.col(f"y{j}")) for j, k in enumerate(("tl", "tr", "br", "bl"))}, F.col("u"), F.col("v"))
    got = {(o.i, o.u, o.v): (o.x, o.y) for o in frame.select("i", "u", "v", x.alias("x"), y.alias("y")).collect()}
    for i, q in enumerate(quads):
        m, b = [], []
        for (u, v), (px, py) in zip(points[:4], q, strict=True):
            assert np.allclose(got[i, u, v], (px, py), atol=1e-6)
            m += [[u, v, 1, 0, 0, 0, -px * u, -px * v], [0, 0, 0, u, v, 1, -py * u, -py * v]]
            b += [px, py]
        a = np.append(np.linalg.solve(m, b), 1).reshape(3, 3)
        for u, v in points[4:]:
            p = a @ (u, v, 1)
            assert np.allclose(got[i, u, v], p[:2] / p[2], atol=1e-6)
    # three corners on one line, or all in one place: between the corners
    flat = spark.createDataFrame([(0.0, 0.0, 5.0, 0.0, 10.0, 0.0, 15.0, 0.0, 0.5, 0.5), (*[1.0] * 8, 0.2, 0.9)], ", ".join(f"{n} double" for n in names) + ", u double, v double")
    assert [(o.x, o.y) for o in flat.coalesce(1).select(x.alias("x"), y.alias("y")).collect()] == [(7.5, 0.0), (1.0, 1.0)]


def test_meshes(spark):
    nodes = [(c * 10.0 + (r_ == 1 and c == 1) * 4, r_ * 20.0) for r_ in range(3) for c in range(3)]
    frame = spark.createDataFrame([(nodes, u, v) for u, v in ((0.0, 0.0), (0.5, 0.5), (1.0, 1.0), (0.25, 0.25), (1.5, 0.0), (-0.5, 1.0))], "n array<struct<x:double,y:double>>, u double, v double")
    x, y = documents.meshed(F.col("n"), F.col("u"), F.col("v"))
    assert [(o.x, o.y) for o in frame.coalesce(1).select(x.alias("x"), y.alias("y")).collect()] == [(0.0, 0.0), (14.0, 20.0), (20.0, 40.0), (6.0, 10.0), (30.0, 0.0), (-10.0, 40.0)]


def test_profiles(spark):
    rows = [
        ("/p/T/a/profile.json", '{"name": "A", "fonts": {"x": {"file": "f"}}, "translation": {"prompt": " old ", "glossary": [{"source": "s"}]}}', 2), ("/p/T/a/profile.json", '{"name": "older"}', 1), ("/p/T/b/profile.json", "broken", 1),
        ("/p/T/c/profile.json", None, 1), ("/p/U/a/profile.json", '{"type": "", "fonts": [1], "translation": {"prompt": "  ", "glossary": {}}}', 1), ("/p/U/d/profile.json", "[]", 1),
    ]
    out = {(r.type, r.project): (r.fonts, r.prompt, r.glossary) for r in documents.profiles(spark.createDataFrame(rows, "path string, text string, modified int"), "default", {"old": "new"}).collect()}
    none = ("{}", "default", "[]")
    assert out == {("T", "A"): ('{"x":{"file":"f"}}', "new", '[{"source":"s"}]'), ("T", "b"): none, ("T", "c"): none, ("U", "a"): none, ("U", "d"): none}


def test_legacy_trees(spark):
    files = spark.createDataFrame([("/old/a/profile.json",), ("/old/a/deep/f.ttf",), ("/old/b/x",), ("/old/.hidden/x",), ("/old/loose.txt",), ("/other/a/x",)], "path string")
    have = spark.createDataFrame([("Manhwas", "b"), ("Other", "a")], "type string, project string")
    got = {tuple(r) for r in documents.legacy_copies(files, "/old/", have, "Manhwas", "/new").collect()}
    assert got == {("/old/a/profile.json", "/new/Manhwas/a/profile.json"), ("/old/a/deep/f.ttf", "/new/Manhwas/a/deep/f.ttf")}
