from types import SimpleNamespace

from .test_registry import SF, boxes_of, own


def test_joined_lines_equal_a_plain_loop(spark):
    want = []
    for page, boxes in boxes_of(spark).items():
        rows = [(b.y, b.x, b.y + b.height, b.x + b.width, b.confidence) for b in boxes]
        again = True
        while again:
            again = False
            rows.sort(key=lambda r: r[:2])
            for i, a in enumerate(rows):
                for b in rows[i + 1 :]:
                    wide = max(0, min(a[3], b[3]) - max(a[1], b[1]))
                    if wide >= 0.25 * max(1, min(a[3] - a[1], b[3] - b[1])) and max(a[0], b[0]) - min(a[2], b[2]) <= 5:
                        again = True
                        break
                if again:
                    break
            if again:
                rows.remove(a)
                rows.remove(b)
                rows.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4])))
        want += [(page, r[1], r[0], r[3] - r[1], r[2] - r[0], round(r[4], 9)) for r in rows]
    got = [(r.page_key, r.x, r.y, r.width, r.height, round(r.confidence, 9)) for r in own().QUERIES["g3_joined_lines"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) < sum(map(len, boxes_of(spark).values()))


def test_crop_batches_equal_a_plain_loop(spark):
    got = {}
    for r in own().QUERIES["g8_crop_batches"](spark, SF).collect():
        got.setdefault((r.page_key, r.batch), []).append(r.idx)
    want = []
    for page, boxes in boxes_of(spark).items():
        boxes = sorted(boxes, key=lambda b: b.idx)
        want += [(page, [b.idx]) for b in boxes if max(b.width, b.height) > 150]
        sizes = {}
        for b in boxes:
            if max(b.width, b.height) <= 150:
                sizes.setdefault(((b.width + 39) // 40, (b.height + 39) // 40), []).append(b)
        for some in sizes.values():
            batch = []
            for b in some:
                more = [*batch, b]
                if batch and (len(more) > 4 or max(x.width for x in more) * max(x.height for x in more) * len(more) > 30_000):
                    want.append((page, [x.idx for x in batch]))
                    more = [b]
                batch = more
            want.append((page, [x.idx for x in batch]))
    assert sorted((page, sorted(ids)) for (page, _), ids in got.items()) == sorted(want)


def test_odd_values(spark):
    from pyspark.sql import functions as F

    from pagequire.operators import fonts, imports, shapes

    rows = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, '{"OBRA": null, "título": " x "}')], "id int, text string")
    found = {r.id: r.c for r in rows.select("id", imports.json_context(F.col("text")).alias("c")).collect()}
    assert found[1] is found[2] is found[3] is None and found[4].title == "x"
    lines = spark.createDataFrame([(1, 1, None), (1, 2, "**Reglas extra**: a"), (1, 3, "Nombres: se dejan"), (1, 4, "# Glosario: "), (2, 1, "")], "doc int, i int, line string")
    got = {(r.doc, r.i): (r.heading, r.section, r.rest) for r in imports.sectioned_lines(lines, "doc", "i", "line").collect()}
    assert got == {(1, 1): (False, None, None), (1, 2): (True, "style", "a"), (1, 3): (False, "style", None), (1, 4): (True, "glossary", ""), (2, 1): (False, None, None)}
    names = spark.createDataFrame([(" b",), ("B",), ("@c",), (" ",), (None,)], "family string")
    assert [r.family for r in fonts.families(names, "family").collect()] == ["B", "b"]
    urls = spark.createDataFrame([(u,) for u in ("https://a.x.org:443/", "https://a.x.org:80/", "https://u@a.x.org", "http://a.x.org", "https://a.x.org?q=1", None, "::", "https://ax.org/v1")], "u string")
    one = [r[0] for r in urls.select(shapes.endpoint(F.col("u"), ".x.org", "/v1", "/v1/chat")).collect()]
    assert one == ["https://a.x.org:443/v1/chat", *[None] * 7]
    assert SimpleNamespace(**spark.range(1).select(shapes.relative_path(F.lit("/a/b"), F.lit("/a")).alias("p"), shapes.relative_path(F.lit("/ab"), F.lit("/a")).alias("q"), shapes.relative_path(F.lit("/ab"), F.lit(None).cast("string")).alias("r")).first().asDict()) == SimpleNamespace(p="b", q=None, r=None)


def test_json_is_read_once(spark):
    """However many fields and names are asked for, a text is parsed once, and each value once more for its rows."""
    from pyspark.sql import functions as F

    from pagequire.operators import imports

    rows = spark.createDataFrame([('{"TITULO":"","obra":"x","Título":"y"}',), ('{"ＯＢＲＡ":"w","obr\u0301a":"v"}',), ('{"title":[],"titulo":["a",null]}',), ('{"rules":"[1,","estilo":0}',), ("[1]",), (None,)], "t string").coalesce(1)
    made = rows.select(imports.json_context(F.col("t")).alias("c"))
    assert [r.c and tuple(r.c) for r in made.collect()] == [("x", "", ""), ("v", "", ""), ("- a\n- None", "", ""), ("", "", "[1,"), None, None]
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json") <= 4
