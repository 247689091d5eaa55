"""Published image token formulas as native columns.

``rule`` is a catalog ``image`` struct column. The patch formula scales an image
to an edge limit, then to a patch limit, and then takes single pixels off the
larger side (the width when equal) until it fits; the number of those steps has
a closed form where patches are square, and is found by binary search elsewhere.

The formula is a list of steps over named values (``_STEPS``). ``image_tokens``
binds them within one column, ``with_image_rule`` and ``with_image_tokens`` by
columns of a table, which Spark compiles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Values = Callable[[str], Column]


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient; divisors below 1 count as 1."""
    return F.call_function("div", a, F.greatest(b, _long(1)))


def ceil_div(a: Column, b: Column) -> Column:
    """Rounded up quotient, 0 unless both are positive."""
    a, b = a.cast("long"), b.cast("long")
    return F.when((a > 0) & (b > 0), _div(a + b - 1, b)).otherwise(_long(0))


def _sides(w: Column, h: Column, k: Column) -> tuple[Column, Column]:
    """Width and height after k single-pixel steps off the larger side."""
    apart = F.abs(w - h)
    first, rest = F.least(k, apart), F.greatest(_long(0), k - apart)
    least = F.least(w, h)
    half = F.call_function("div", rest, _long(2))
    wide = F.when(k <= apart, F.when(w > h, w - first).otherwise(w)).otherwise(least - (rest - half))
    high = F.when(k <= apart, F.when(w > h, h).otherwise(h - first)).otherwise(least - half)
    return wide, high


def _limits(v: Values) -> dict[str, Column]:
    """What the rule says of the detail."""
    d, rule = F.try_element_at(v("rule")["details"], v("detail")), v("rule")
    return {
        "kind": rule["kind"], "pw": rule["patch_width"].cast("long"), "ph": rule["patch_height"].cast("long"), "multiplier": rule["multiplier"], "small": rule["small_threshold"].cast("long"), "tile": rule["tile_size"].cast("long"),
        "per_tile": rule["tokens_per_tile"], "mode": d["mode"], "fixed": d["fixed_tokens"], "edge": d["max_edge"].cast("long"), "most": d["max_patches"],
    }


def _real(c: Column) -> Column:
    return c.cast("double")


def _scaled(side: Column, factor: Column) -> Column:
    return F.greatest(_long(1), F.floor(_real(side) * factor).cast("long"))


def _to_edge(v: Values) -> dict[str, Column]:
    w, h, edge = v("w"), v("h"), v("edge")
    factor = F.least(F.try_divide(_real(edge), _real(w)), F.try_divide(_real(edge), _real(h)))
    over = (edge > 0) & ((w > edge) | (h > edge))
    return {"w1": F.when(over, _scaled(w, factor)).otherwise(w), "h1": F.when(over, _scaled(h, factor)).otherwise(h)}


def _patches(v: Values) -> dict[str, Column]:
    return {"p1": ceil_div(v("w1"), v("pw")) * ceil_div(v("h1"), v("ph"))}


def _to_patches(v: Values) -> dict[str, Column]:
    factor = F.sqrt(F.try_divide(_real(v("most")), _real(v("p1"))))
    over = F.coalesce((v("most") > 0) & (v("p1") > v("most")), F.lit(False))
    return {"over": over} | {f"{x}2": F.when(over, _scaled(v(f"{x}1"), factor)).otherwise(v(f"{x}1")) for x in "wh"}


def _taken(v: Values) -> dict[str, Column]:
    """Pixels that are taken off: first of the larger side until the sides are equal, then of both in turn."""
    w, h, most = v("w2"), v("h2"), v("most")
    larger, least = F.greatest(w, h), F.least(w, h)
    of_larger, of_least = F.when(w > h, v("pw")).otherwise(v("ph")), F.when(w > h, v("ph")).otherwise(v("pw"))
    # the larger side keeps as many whole patches as the other one leaves it
    longest = _div(most, ceil_div(least, of_least)) * of_larger
    # then sides of n and n, or n and n + 1 patches
    n = F.floor(F.sqrt(_real(most))).cast("long")
    square = (larger - least) + (least - n * v("pw")) * 2 - F.when(n * (n + 1) <= most, _long(1)).otherwise(_long(0))
    fits = lambda k: (lambda x, y: ceil_div(x, v("pw")) * ceil_div(y, v("ph")) <= most)(*_sides(w, h, k))
    search = F.aggregate(F.array(*[_long(1 << i) for i in reversed(range(20))]), _long(0), lambda k, n: F.when((k + n <= w + h) & ~fits(k + n - 1), k + n).otherwise(k))
    steps = F.when(longest >= least, F.greatest(_long(0), larger - longest)).when(v("pw") == v("ph"), square).otherwise(search)
    return {"k": F.when(v("over"), steps).otherwise(_long(0))}


def _planned(v: Values) -> dict[str, Column]:
    w, h = _sides(v("w2"), v("h2"), v("k"))
    return {"w3": w, "h3": h}


def _counted(v: Values) -> dict[str, Column]:
    tiles = F.when((v("w") <= v("small")) & (v("h") <= v("small")), _long(1)).otherwise(ceil_div(v("w"), v("tile")) * ceil_div(v("h"), v("tile")))
    return {"patches": ceil_div(v("w3"), v("pw")) * ceil_div(v("h3"), v("ph")), "tiles": tiles}


def _result(v: Values) -> dict[str, Column]:
    names = ("tokens", "planned_w", "planned_h", "patches", "tiles")
    result = lambda *values: F.struct(*[x.cast("long").alias(n) for n, x in zip(names, values, strict=True)])
    w, h, edge, none = v("w"), v("h"), v("edge"), _long(0)
    fixed = result(v("fixed"), F.when(edge > 0, edge).otherwise(w), F.when(edge > 0, edge).otherwise(h), F.when(edge > 0, ceil_div(edge, v("pw")) * ceil_div(edge, v("ph"))).otherwise(none), none)
    out = F.when(v("mode") == "fixed", fixed).when(v("kind") == "gemini-tile", result(v("tiles") * v("per_tile"), w, h, none, v("tiles")))
    return {"result": out.when(v("kind") == "patch", result(F.ceil(_real(v("patches")) * v("multiplier")), v("w3"), v("h3"), v("patches"), none))}


#: Each step adds values to those before it.
_STEPS = (_limits, _to_edge, _patches, _to_patches, _taken, _planned, _counted, _result)


def image_tokens(rule: Column, detail: Column, width: Column, height: Column) -> Column:
    """struct(tokens, planned_w, planned_h, patches, tiles) as one column, for a few rows; null for a detail that the rule lacks."""
    values = {"rule": rule, "detail": detail, "w": width.cast("long"), "h": height.cast("long")}
    bound, names = F.array(F.struct(*[x.alias(n) for n, x in values.items()])), list(values)
    for step in _STEPS:
        # one-element transforms bind each step's values once
        added = lambda s: F.struct(*[s[n].alias(n) for n in names], *[x.alias(n) for n, x in step(lambda n: s[n]).items()])  # noqa: E731, B023
        bound, names = F.transform(bound, added), [*names, *step(F.col)]
    return bound[0]["result"]


def _own(name: str, value: str) -> str:
    return f"_{name}_{value}"


def with_image_rule(df: DataFrame, name: str, rule: Column, detail: Column) -> DataFrame:
    """``df`` with what a rule says of a detail, as columns for ``with_image_tokens``; the rule itself need not go on."""
    return df.withColumns({_own(name, n): c for n, c in _limits({"rule": rule, "detail": detail}.get).items()})


def with_image_tokens(df: DataFrame, name: str, width: Column, height: Column) -> DataFrame:
    """``df`` from ``with_image_rule`` with ``image_tokens`` as the column ``name``; null without a width."""
    at = lambda n: F.col(_own(name, n))
    before = [n for n in df.columns if not n.startswith(_own(name, ""))]
    df = df.withColumns({_own(name, "w"): width.cast("long"), _own(name, "h"): height.cast("long")})
    for step in _STEPS[1:]:
        df = df.withColumns({_own(name, n): c for n, c in step(at).items()})
    return df.select(*before, F.when(at("w").isNotNull(), at("result")).alias(name))


def audio_tokens(duration_ms: Column, per_second: Column) -> Column:
    return F.ceil(duration_ms.cast("double") / F.lit(1000.0) * per_second).cast("long")


def page_pixels(points: Column, default: int) -> Column:
    """Pixels of a PDF page's side at 150 dpi, or the default where its size is unknown."""
    return F.when(points > 0, F.ceil(points.cast("double") * F.lit(150.0) / F.lit(72.0))).otherwise(F.lit(default)).cast("long")
