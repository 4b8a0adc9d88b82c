"""Documents as JSON: fingerprints whatever their keys' order, signatures of layer states, profiles with defaults; and warps."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import has_text, let

# fixed values: fields that hold pixels, and default states of a layer
PIXELS = ("pixels", "mask", "residual_mask", "png_bytes")
VISIBLE, OPACITY = True, 100


def document_fingerprint(document: Column, left_out: tuple[str, ...] = PIXELS) -> Column:
    """SHA-256 of a JSON document in a canonical form: keys in order at any depth, no spaces, and of fields that hold pixels
    only whether they are there. Null for null; text that is no JSON, or nests deeper than parsers read, counts as it is."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        def canonical(text: str) -> str:
            try:
                prune = lambda pairs: {k: v is not None if k in left_out else v for k, v in pairs}
                return json.dumps(json.loads(text, object_pairs_hook=prune), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                return text

        return texts.map(lambda t: None if t is None else hashlib.sha256(canonical(t).encode("utf-8", "surrogatepass")).hexdigest())

    return digest(document)


def state_signature(states: Column) -> Column:
    """Of a map of layer ids to (visible, opacity): the states in the order of ids as text, defaults for what is null."""
    one = lambda e: F.concat_ws(":", e["key"], F.coalesce(e["value"]["visible"], F.lit(VISIBLE)).cast("string"), F.coalesce(e["value"]["opacity"], F.lit(OPACITY)).cast("string"))
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.transform(F.map_entries(states), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))), one), "|"), F.lit(""))


def profiles(files: DataFrame, default_prompt: str, outdated: dict[str, str] | None = None) -> DataFrame:
    """Profiles out of files (path `.../type/project/profile.json`, text, modified): type, project, fonts (JSON), prompt and
    glossary (JSON). Of several files of a project the latest counts, of these the last by path. What a profile lacks, or
    all of it where it is no JSON object, has defaults; prompts known as outdated are replaced."""
    part = lambda i: F.element_at(F.split("path", "/"), -i)
    rows = files.select(part(3).alias("type"), part(2).alias("project"), F.struct("modified", "path", "text").alias("f"))
    rows = rows.groupBy("type", "project").agg(F.max("f")["text"].alias("text")).withColumn("v", F.try_parse_json("text"))
    field = lambda path, kind="string": F.try_variant_get("v", path, kind)
    prompt = F.coalesce(F.when(has_text(field("$.translation.prompt")), field("$.translation.prompt")), F.lit(default_prompt))
    if outdated:
        newer = F.create_map(*[F.lit(x.strip()) for pair in outdated.items() for x in pair])
        prompt = let(prompt, lambda p: F.coalesce(F.try_element_at(newer, F.trim(p)), p))
    fonts, terms = F.try_variant_get("v", "$.fonts", "variant"), F.try_variant_get("v", "$.translation.glossary", "variant")
    shaped = lambda c, kind, none: F.when(F.schema_of_variant(c).startswith(kind), F.to_json(c)).otherwise(none)
    return rows.select(F.coalesce(F.nullif(field("$.type"), F.lit("")), "type").alias("type"), F.coalesce(F.nullif(field("$.name"), F.lit("")), "project").alias("project"), shaped(fonts, "OBJECT", "{}").alias("fonts"), prompt.alias("prompt"), shaped(terms, "ARRAY", "[]").alias("glossary"))


def legacy_copies(files: DataFrame, root: str, projects: DataFrame, default_type: str, target: str) -> DataFrame:
    """What to copy (path, to) of a flat tree `root/project/...` into `target/type/project/...`: files of projects that the
    default type does not have yet (projects: type, project), hidden folders left out. Nothing is deleted or replaced."""
    below = F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 30)
    rows = files.filter(F.col("path").startswith(root.rstrip("/") + "/")).select("path", below.alias("below"))
    rows = rows.withColumn("project", F.substring_index("below", "/", 1)).filter(F.col("below").contains("/") & ~F.col("project").startswith("."))
    new = rows.join(projects.filter(F.col("type") == default_type).select("project").distinct(), "project", "left_anti")
    return new.select("path", F.concat(F.lit(f"{target.rstrip('/')}/{default_type}/"), "below").alias("to"))


def projective(corners: dict[str, tuple[Column, Column]], u: Column, v: Column) -> tuple[Column, Column]:
    """Where a point of the unit square goes when its corners (tl, tr, br, bl) go to the given ones in perspective; where
    there is no such map, or the point has no image, between the corners by their shares."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = (tuple(c.cast("double") for c in corners[k]) for k in ("tl", "tr", "br", "bl"))
    ax, ay, bx, by = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    det = ax * by - ay * bx
    safe = F.when(F.abs(det) > 1e-9, det)
    g, h = (sx * by - sy * bx) / safe, (ax * sy - ay * sx) / safe
    below = g * u + h * v + 1
    below = F.when(F.abs(below) >= 1e-9, below)
    flat = lambda a, b, c, d: (a * (1 - u) + b * u) * (1 - v) + (d * (1 - u) + c * u) * v
    at = lambda a, b, d: ((b - a + g * b) * u + (d - a + h * d) * v + a) / below
    return F.coalesce(at(x0, x1, x3), flat(x0, x1, x2, x3)), F.coalesce(at(y0, y1, y3), flat(y0, y1, y2, y3))


def meshed(nodes: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Where a point of the unit square goes on a mesh of three by three nodes (an array of x and y, row by row): between the
    nodes of its cell, beyond the edges as these cells go on."""
    column, row = F.when(u < 0.5, 0).otherwise(1), F.when(v < 0.5, 0).otherwise(1)
    a, b = 2 * u - column, 2 * v - row
    node = lambda dr, dc: F.get(nodes, (row + dr) * 3 + column + dc)
    along = lambda c: (node(0, 0)[c] * (1 - a) + node(0, 1)[c] * a) * (1 - b) + (node(1, 0)[c] * (1 - a) + node(1, 1)[c] * a) * b
    return along("x"), along("y")
