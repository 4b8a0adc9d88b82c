"""Fonts and looks of regions: roles by name, defaults where nothing is set, flags, presets. Styles are maps of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import has_text, stripped
from .imports import among

# fixed values: names of the font roles of each kind of balloon
ROLES = {
    "dialogue": ["dialogo", "dialogue"],
    "shout": ["grito", "gritos", "shout", "shouts"],
    "thought": ["pensamiento", "pensamientos", "thought", "thoughts"],
    "sfx": ["sfx", "onomatopeya", "onomatopeyas", "efecto", "efectos", "efectos de sonido"],
    "caption": ["cuadro", "cuadros", "narracion", "narrador", "caption", "narration", "narrator"],
}
EMPTY = "map<string,string>"


def fonts_of_kinds(fonts: DataFrame, project: str, order: str, alias: str, family: str) -> DataFrame:
    """project, kind, alias and family: a project's first font whose alias names the kind, but for case and accents."""
    name = stripped(F.col(alias))
    kinds = F.filter(F.array(*[F.when(among(name, names), F.lit(kind)) for kind, names in ROLES.items()]), lambda k: k.isNotNull())
    rows = fonts.select(F.col(project).alias("project"), F.col(order).alias("o"), F.col(alias).alias("alias"), F.col(family).alias("family"), F.explode(kinds).alias("kind"))
    return rows.groupBy("project", "kind").agg(F.min(F.struct("o", "alias", "family")).alias("m")).select("project", "kind", "m.alias", "m.family")


def families(fonts: DataFrame, family: str) -> DataFrame:
    """The families, each once, in order but for case; blank names and those that begin with @ are left out."""
    name = stripped(F.col(family))
    return fonts.filter(~F.col(family).startswith("@")).select(name.alias("family")).filter("family <> ''").distinct().orderBy(F.lower("family"), "family")


def _style(style: str) -> Column:
    return F.coalesce(F.col(style), F.create_map().cast(EMPTY))


def over(style: Column, more: Column) -> Column:
    """A style with what another says on top."""
    return F.map_zip_with(style, more, lambda _, a, b: F.coalesce(b, a))


def role_defaults(regions: DataFrame, alias: Column, family: Column, look: Column, role: str = "font_role", style: str = "style") -> DataFrame:
    """Regions without a role and a family of their own get the role, its look and its family, where both are named."""
    own = has_text(F.col(role)) | has_text(_style(style)["font_family"])
    put = has_text(alias) & has_text(family) & ~own
    new = over(over(_style(style), look), F.create_map(F.lit("font_family"), family))
    return regions.withColumns({role: F.when(put, alias).otherwise(F.col(role)), style: F.when(put, new).otherwise(F.col(style))})


def adaptive_flags(regions: DataFrame, style: str = "style", flags: tuple[str, ...] = ("auto_fit", "balloon_fit")) -> DataFrame:
    """Sets the flags that a style does not mention, but for lettered effects."""
    now = _style(style)
    new = now
    for f in flags:
        new = F.when(F.map_contains_key(now, f), new).otherwise(over(new, F.create_map(F.lit(f), F.lit("true"))))
    return regions.withColumn(style, F.when(F.coalesce(now["sfx_enabled"], F.lit("false")) == "true", now).otherwise(new))


def looks_of_kinds(regions: DataFrame, looks: DataFrame, kind: str = "kind", style: str = "style") -> DataFrame:
    """Regions with the look of their kind on top of their style. `looks`: a row (kind, look) for each kind."""
    one = looks.select(F.col("kind").alias("__kind"), F.col("look").alias("__look"))
    rows = regions.join(one, F.col(kind) == F.col("__kind"), "left")
    return rows.withColumn(style, F.when(F.col("__look").isNull(), _style(style)).otherwise(over(_style(style), F.col("__look")))).drop("__kind", "__look")
