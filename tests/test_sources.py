import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from pagequire.sources.bundles import bundle_pages, bundle_regions, read_assets, read_bundles, resolved_pages, write_bundles
from pagequire.sources.files import slice_plan, write_files, write_slices
from pagequire.sources.folders import image_size, scan_pages, without_collisions
from pagequire.streaming.files import stable_files


def png(w, h):
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_image_sizes():
    assert image_size(png(30, 40)) == (30, 40)
    assert image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x07") == (7, 5)
    assert image_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 9, -8)) == (9, 8)
    assert image_size(b"RIFF....WEBPVP8X" + b"\0" * 8 + b"\x09\0\0\x13\0\0") == (10, 20)
    assert image_size(b"") is None


def test_folder_scan(spark, tmp_path):
    for name in ("10.png", "2.PNG", "1.png", "x.txt"):
        (tmp_path / name).write_bytes(png(5, 6))
    rows = scan_pages(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.name, r.width, r.height, r.size_label) for r in rows] == [(n, 5, 6, "0.0 MB") for n in ("1.png", "2.PNG", "10.png")]


def test_collisions(spark):
    targets = spark.createDataFrame([("/a/1.png",), ("/b/2.png",)], "path string")
    got = without_collisions(targets, targets.limit(1), "path")
    assert {r.path for r in got.collect()} == {"/a/export/1.png", "/b/2.png"}


def test_bundles_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("c1", 0, "k0", "n0", 10, 20), ("c1", 1, "k1", "n1", 11, 21), ("c2", 0, "//host/x", "n", 1, 1)], "chapter_id string, ord int, page_key string, name string, width int, height int")
    regions = spark.createDataFrame([("c1", "k0", 0, "r", 1, 2, 3, 4, 0.5, "té", None), ("c1", "k0", 1, "s", 1, 2, 3, 4, 0.5, "u", "v")], "chapter_id string, page_key string, ord int, id string, x int, y int, width int, height int, confidence double, text string, translation string")
    write_bundles(pages, regions, str(tmp_path))
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "new.zip", "w") as z:
        z.writestr("project.json", '{"version": 99, "pages": []}')
    read = read_bundles(spark, str(tmp_path)).cache()
    assert {r.error for r in read.collect()} == {None, "BadZipFile", "newer version"}
    assert sorted((r.ord, r.page_key, r.name, r.width) for r in bundle_pages(read).collect()) == [(0, "k0", "n0", 10), (1, "k1", "n1", 11)]
    assert [(r.id, r.text, r.translation) for r in bundle_regions(read).orderBy("ord").collect()] == [("r", "té", None), ("s", "u", "v")]


def test_stable_files(spark, tmp_path):
    seen = [("a", 1, 5, 1), ("a", 2, 5, 2), ("a", 2, 5, 3), ("a", 2, 5, 4), ("b", 1, 0, 1), ("b", 1, 0, 2), ("a", 3, 6, 5), ("a", 3, 6, 6)]
    spark.createDataFrame(seen, "path string, modified long, length long, seen long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, modified long, length long, seen long").parquet(str(tmp_path / "in"))
    query = stable_files(stream).writeStream.format("memory").queryName("stable").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("stable").collect())) == [("a", 2, 5), ("a", 3, 6)]




def test_bundles_carry_assets_and_odd_names(spark, tmp_path):
    pages = spark.createDataFrame([("c", i, f'k"{i}\\é', f"n{i}", i, i) for i in range(40)] + [("d", 0, None, None, None, None)], "chapter_id string, ord int, page_key string, name string, width int, height int")
    regions = spark.createDataFrame([("c", f'k"{i}\\é', j, f"r{j}", 1, 2, 3, 4, 0.5, "x\n", None) for i in (3, 7) for j in range(3)] + [("gone", "k", 0, "r", 1, 1, 1, 1, 0.1, "", "")], "chapter_id string, page_key string, ord int, id string, x int, y int, width int, height int, confidence double, text string, translation string")
    assets = spark.createDataFrame([("c", "patches/0.png", bytearray(b"12")), ("c", "assets/w.png", bytearray(b"")), ("gone", "a", bytearray(b"1"))], "chapter_id string, asset string, content binary")
    for _ in range(2):  # a second time in place of the first
        write_bundles(pages.repartition(5), regions, str(tmp_path), assets)
    assert sorted(p.suffix for p in tmp_path.iterdir()) == [".zip", ".zip"]
    read = read_bundles(spark, str(tmp_path))
    assert [(r.ord, r.page_key, r.width) for r in bundle_pages(read).filter("name is not null").orderBy("ord").collect()] == [(i, f'k"{i}\\é', i) for i in range(40)]
    assert bundle_regions(read).groupBy("page_key").count().count() == 2 and bundle_regions(read).count() == 6
    assert sorted((r.asset, bytes(r.content)) for r in read_assets(spark, str(tmp_path)).collect()) == [("assets/w.png", b""), ("patches/0.png", b"12")]


def test_pages_are_found_by_their_candidate_paths(spark, tmp_path):
    project = {"version": 1, "source_root": "/old/root", "pages": [{"name": n, "path": p, "relative_path": r} for n, p, r in [("a", "/x/a.png", "a.png"), ("b", "/x/b.png", "b.png"), ("c", "/x/c.png", ""), ("d", "//host/d.png", None), ("e", None, "e.png")]]}
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("project.json", json.dumps(project))
    files = spark.createDataFrame([("/old/root/a.png",), (f"file:{tmp_path}/a.png",), (f"file:{tmp_path}/b.png",), ("/x/c.png",), ("//host/d.png",), ("/x/b.png",)], "path string")
    got = {r["name"]: (r.page_key, r.missing) for r in resolved_pages(read_bundles(spark, str(tmp_path)), files).collect()}
    assert got == {"a": ("/old/root/a.png", False), "b": (f"{tmp_path}/b.png", False), "c": ("/x/c.png", False), "d": (None, True), "e": (None, True)}


def test_slices_replace_earlier_ones_together(spark, tmp_path):
    slices = lambda n, bad=False: spark.range(1, n + 1).repartition(3).selectExpr("id as number", "cast(if(id = 2 and %s, raise_error('lost'), concat('s', id)) as binary) as content" % bad)
    (tmp_path / "cover.jpg").write_bytes(b"stays")
    write_slices(slices(5), str(tmp_path), archive="all.zip")
    assert {p.name for p in tmp_path.iterdir()} == {"cover.jpg", "all.zip", *(f"00{i}.jpg" for i in range(1, 6))}
    with pytest.raises(Exception, match="lost"):
        write_slices(slices(3, True), str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"cover.jpg", "all.zip", *(f"00{i}.jpg" for i in range(1, 6))} and (tmp_path / "002.jpg").read_bytes() == b"s2"
    write_slices(slices(2), str(tmp_path), ending="png")
    assert {p.name for p in tmp_path.iterdir()} == {"cover.jpg", "all.zip", "001.png", "002.png"}
    with zipfile.ZipFile(tmp_path / "all.zip") as z:
        assert [(n, z.read(n)) for n in sorted(z.namelist())] == [(f"00{i}.jpg", b"s%d" % i) for i in range(1, 6)]
    write_slices(slices(0), str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"cover.jpg", "all.zip"}


def test_names_outside_the_folder_are_refused(spark, tmp_path):
    for name in ("../x", "", "_temporary"):
        with pytest.raises(Exception, match="no name"):
            write_files(spark.createDataFrame([(name, 0, bytearray(b"1"))], "file string, ord int, content binary").withColumn("entry", F.lit(None).cast("string")), str(tmp_path / "out"))


def test_slice_plan(spark):
    rows = spark.createDataFrame([("a", 2000), ("b", 2240), ("c", 2250), ("d", 30), ("e", 0), ("f", None)], "chapter_id string, height long")
    got = {}
    for r in slice_plan(rows, 1000).orderBy("number").collect():
        got.setdefault(r.chapter_id, []).append((r.top, r.bottom))
    assert got == {"a": [(0, 1000), (1000, 2000)], "b": [(0, 1000), (1000, 2240)], "c": [(0, 1000), (1000, 2000), (2000, 2250)], "d": [(0, 30)]}


def test_heads_of_odd_files(spark, tmp_path):
    """A JPEG whose size stands behind much else, names with spaces and signs, empty and broken files."""
    segment = b"\xff\xe1\xff\xff" + b"\0" * 65533
    (tmp_path / "deep er").mkdir()
    (tmp_path / "deep er" / "a #1 %20é.jpg").write_bytes(b"\xff\xd8" + segment * 3 + b"\xff\xc0\x00\x11\x08\x00\x05\x00\x07" + b"\0" * 20)
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8\xff")
    rows = {r.name: (r.width, r.height, r.ord, r.length) for r in scan_pages(spark, str(tmp_path)).collect()}
    assert rows == {"a #1 %20é.jpg": (7, 5, 0, 196642), "broken.jpg": (None, None, 0, 3)}
    plan = scan_pages(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "content" not in plan[plan.index("Physical Plan") :]
