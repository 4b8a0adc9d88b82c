"""Settings held to their limits: numbers to ranges, words to lists, flags and colours to their forms. Settings are maps
of strings; keys that no rule names stay as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import half_even

EMPTY = "map<string,string>"

# fixed values: styles' whole numbers with least, most and default
STYLE_NUMBERS = {
    "font_size": (6, 300, 36), "line_spacing": (-10, 100, 4), "balloon_padding": (2, 80, 10), "max_horizontal_compression": (0, 20, 12),
    "scale_x": (50, 200, 100), "scale_y": (50, 200, 100), "stroke_width": (0, 20, 0), "stroke2_width": (1, 40, 6),
    "glow_radius": (1, 80, 10), "glow_opacity": (0, 100, 65), "shadow_blur": (0, 80, 8), "shadow_offset_x": (-100, 100, 4),
    "shadow_offset_y": (-100, 100, 6), "shadow_opacity": (0, 100, 65), "rotation": (-180, 180, 0), "text_margin": (0, 200, 8),
    "sfx_curve": (-100, 100, 0), "sfx_wave": (0, 100, 0), "sfx_wave_cycles": (1, 8, 2), "sfx_skew": (-60, 60, 0),
    "sfx_expansion": (-80, 150, 0), "sfx_impact": (-100, 100, 0),
}
# fixed values: styles' words, the default first
STYLE_WORDS = {
    "text_case": ["original", "upper", "lower"],
    "balloon_shape": ["auto", "ellipse", "diamond", "rectangle"],
    "language": ["auto", "es", "zh", "ja", "ko"],
    "blend_mode": ["normal", "multiply", "screen", "overlay"],
}
# fixed values: styles' colours with defaults
STYLE_COLOURS = {"gradient_start": "#FFFFFF", "gradient_end": "#00CFE8", "glow_color": "#00CFE8", "stroke_color": "#FFFFFF", "stroke2_color": "#111111", "shadow_color": "#000000"}
# fixed values: styles' flags with defaults
STYLE_FLAGS = {"italic": False, "underline": False, "strikeout": False, "auto_fit": True, "balloon_fit": True, "hyphenation": True, "orphan_control": True, "hanging_punctuation": True, "auto_scale": True, "optical_center": True, "sfx_enabled": False}
# fixed values: corners of a layer in percent
CORNERS = {"tl": (0, 0), "tr": (100, 0), "bl": (0, 100), "br": (100, 100)}
# fixed values: logos' whole numbers with least, most and default
LOGO_NUMBERS = {
    "scale_percent": (1, 100, 14), "width_px": (8, 20000, 320), "opacity": (0, 100, 65), "margin_x": (0, 10000, 24), "margin_y": (0, 10000, 24),
    "repeat_spacing_x": (0, 10000, 0), "repeat_spacing_y": (0, 10000, 900), "offset_x": (-20000, 20000, 0), "offset_y": (-20000, 20000, 0),
    "rotation": (-180, 180, 0), "minimum_gap": (0, 10000, 48), "interval_px": (0, 100000, 0), "auto_count_limit": (1, 600, 600), "repeat_count": (1, 100, 3),
}
# fixed values: logos' words, the default first
LOGO_WORDS = {
    "size_mode": ["percent", "pixels"],
    "anchor": ["bottom-right", "top-left", "top-center", "top-right", "middle-left", "center", "middle-right", "bottom-left", "bottom-center"],
    "blend_mode": ["normal", "multiply", "screen", "overlay"],
    "distribution": ["column", "alternating", "adaptive"],
}
# fixed values: logos' flags with defaults
LOGO_FLAGS = {"active": False, "trim_transparent": True, "repeat": False, "auto_count": True, "keep_inside": True, "visible_preview": True, "avoid_text": True, "seam_safe": True}
#: Words that count in any case.
ANY_CASE = {"balloon_shape", "language", "blend_mode"}


def number(value: Column, default: int) -> Column:
    """A string as a number; what is none, or beyond 10^15, is the default."""
    n = value.try_cast("double")
    return F.when(F.abs(n) <= 1e15, n).otherwise(F.lit(float(default)))


def ranged(value: Column, least: int, most: int, default: int) -> Column:
    """A string as a whole number, cut towards zero and held between two."""
    return F.greatest(F.lit(least), F.least(F.lit(most), number(value, default))).cast("long")


def word(value: Column, words: list[str], any_case: bool = False) -> Column:
    """One of the words, else the first of them."""
    v = F.lower(value) if any_case else value
    return F.when(v.isin(words), v).otherwise(F.lit(words[0]))


def colour(value: Column, default: str) -> Column:
    """A sign # with 3, 6 or 8 more characters, in capitals; else the default."""
    v = F.upper(F.trim(value))
    return F.when(v.startswith("#") & F.length(v).isin(4, 7, 9), v).otherwise(F.lit(default))


def yes(value: Column, default: bool) -> Column:
    return F.coalesce(F.lower(value).isin("true", "1"), F.lit(default)).cast("string")


def put(settings: Column, values: dict[str, Column], gone: tuple[str, ...] = ()) -> Column:
    """Settings with these values, and without the keys that are gone."""
    own = F.map_filter(settings, lambda k, _: ~k.isin(*values, *gone))
    return F.map_concat(own, F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()])))


def _held(s: Column, numbers: dict, words: dict, flags: dict, colours: dict) -> dict[str, Column]:
    out = {k: ranged(s[k], *limits) for k, limits in numbers.items()}
    out |= {k: word(s[k], w, k in ANY_CASE) for k, w in words.items()}
    return out | {k: yes(s[k], d) for k, d in flags.items()} | {k: colour(s[k], d) for k, d in colours.items()}


def corner(s: Column, name: str) -> dict[str, Column]:
    """The place of a corner: its own where a style has free corners, else a quarter of the older offset."""
    free = F.exists(F.map_keys(s), lambda k: k.rlike("^sfx_quad_(tl|tr|bl|br)_[xy]$")) | (number(s["sfx_quad_version"], 0) >= 1)
    out = {}
    for axis, base, old in zip("xy", CORNERS[name], (f"sfx_node_{name}_x", f"sfx_node_{name}"), strict=True):
        at = F.when(free, number(s[f"sfx_quad_{name}_{axis}"], base)).otherwise(base + ranged(s[old], -100, 100, 0) * 0.25)
        out[f"sfx_quad_{name}_{axis}"] = F.greatest(F.lit(-5000), F.least(F.lit(5000), half_even(at)))
    return out


def style_in_limits(style: Column) -> Column:
    """A style with every setting named above, each within its limits. Weights go to the nearest hundred, the lower of
    two; an old `bold` counts where no weight is set; alternative families are dropped. Null is an empty style."""
    s = F.coalesce(style, F.create_map().cast(EMPTY))
    bold = F.when(F.map_contains_key(s, "bold") & ~F.map_contains_key(s, "font_weight"), F.when(yes(s["bold"], False) == "true", "700").otherwise("400")).otherwise(s["font_weight"])
    values = _held(s, STYLE_NUMBERS, STYLE_WORDS, STYLE_FLAGS, STYLE_COLOURS)
    values["font_weight"] = F.greatest(F.lit(100), F.least(F.lit(900), F.ceil((ranged(bold, -10000, 10000, 400) - 50) / 100) * 100))
    values["gradient_angle"] = F.pmod(number(s["gradient_angle"], 90).cast("long"), F.lit(360))
    for name in CORNERS:
        values |= corner(s, name)
    values["sfx_quad_version"] = F.lit(1)
    return put(s, values, ("bold", "fallback_fonts"))


def logo_in_limits(settings: Column) -> Column:
    """A logo's settings, those named above within their limits. Null is an empty map."""
    s = F.coalesce(settings, F.create_map().cast(EMPTY))
    return put(s, _held(s, LOGO_NUMBERS, LOGO_WORDS, LOGO_FLAGS, {}))


def named_pages(pages: Column) -> Column:
    """The pages that a logo stands on, each once in order, without empty names."""
    return F.array_distinct(F.filter(F.coalesce(pages, F.array().cast("array<string>")), lambda p: F.length(p) > 0))


def places(positions: Column) -> Column:
    """Points of at least two coordinates, cut to two; null stays null."""
    return F.transform(F.filter(positions, lambda p: F.size(p) >= 2), lambda p: F.slice(p, 1, 2))
