"""Scalar expressions with the rounding, null and NaN rules that the operators rely on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Target pixel spacing in millimetres.
TARGET_SPACING = {"x40": 0.00025, "x20": 0.0005, "x10": 0.001}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_nan(x: Column | str) -> Column:
    """NaN as null, so that comparisons drop it."""
    x = _c(x)
    return F.when(~F.isnan(x), x)


def finite(x: Column | str) -> Column:
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def quantised(x: Column | str, digits: int = 6) -> Column:
    """x to a number of decimals, half up, by arithmetic that is the same in every engine."""
    return F.floor(_c(x) * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def to_half(x: Column | str) -> Column:
    """x as the nearest half-precision number (ties to even; subnormal numbers included)."""
    x = _c(x).cast("double")
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(F.nullif(x, F.lit(0.0))))), F.lit(-14)) - 10)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / unit) * unit)


def uniform(key: Column | str, seed: int | str = 0) -> Column:
    """A draw in (0, 1) that depends on the row's key and the seed alone, not on how rows are dealt."""
    digits = F.substring(F.md5(F.concat(_c(key).cast("string"), F.lit(f":{seed}"))), 1, 7)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(1)) / F.lit(268435457.0)


def hash_order(key: Column | str, seed: int | str = 0) -> Column:
    return F.md5(F.concat(_c(key).cast("string"), F.lit(f":{seed}")))


def clip(x: Column, lo: float | None, hi: float | None) -> Column:
    x = F.greatest(F.lit(lo), x) if lo is not None else x
    return F.least(F.lit(hi), x) if hi is not None else x


def normalised_name(x: Column | str) -> Column:
    return F.replace(F.lower(_c(x)), F.lit("-"), F.lit("_"))


def comma_list(x: Column | str) -> Column:
    """A comma-separated text as trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(_c(x), ","), lambda s: F.trim(s)), lambda s: s != "")


def as_text(x: Column | str) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit("None"))


# What makes up a group, when slides are ranked by density and when they are balanced.
DENSITY_GROUPS = {"site": ("site",), "site_codec": ("site", "codec"), "collection_site_codec": ("collection", "site", "codec")}
BALANCE_GROUPS = {"collection": ("collection",), "collection_site": ("collection", "site"), "collection_site_stain": ("collection", "site", "stain")}


def _parts(modes: dict[str, tuple[str, ...]], mode: str, columns: dict[str, Column | str]) -> list[Column]:
    if mode not in modes:
        raise ValueError(f"unknown group mode: {mode}")
    return [_c(columns[name]) for name in modes[mode]]


def density_key(mode: str, **columns: Column | str) -> Column:
    """The group in which a slide is ranked by density (columns site, codec, collection); null where a part is null."""
    return F.concat(*[x for i, p in enumerate(_parts(DENSITY_GROUPS, mode, columns)) for x in ([F.lit("||")] if i else []) + [p.cast("string")]])


def balance_key(mode: str, **columns: Column | str) -> Column:
    """The group that a balanced sample takes a slide from (columns collection, site, stain); a null part counts as the text None."""
    return F.concat_ws("||", *(as_text(p) for p in _parts(BALANCE_GROUPS, mode, columns)))


def unknown_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with UNKNOWN for null in those of the text columns that it has."""
    return df.fillna("UNKNOWN", [c for c in columns if c in df.columns])


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """How many of the ascending bounds are below the value: a halving search, as a fold."""
    if not bounds:
        return F.lit(0)
    at = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(at, lo + step - 1) < value, lo + step).otherwise(lo))


def micrometres(mm: Column | str) -> Column:
    mm = no_nan(_c(mm).cast("double"))
    return F.when(mm > 0, mm * 1000)


def mean_spacing(*values: Column | str) -> Column:
    """Mean of those values that are positive numbers (given as text or number); null if none is."""
    numbers = [_c(v).try_cast("double") for v in values]
    kept = F.filter(F.array(*numbers), lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.size(kept))


def objective_power(spacing: Column, *values: Column | str) -> Column:
    """The first positive property, else ten over the spacing."""
    tried = [_c(v).try_cast("double") for v in values]
    return F.coalesce(*(F.when(v > 0, v) for v in tried), F.try_divide(F.lit(10.0), F.when(spacing > 0, spacing)))


def target_spacing(level0: Column, power: Column, magnification: float) -> Column:
    """Micrometres per pixel at the magnification, from the objective power, or ten over the base spacing where it is unknown."""
    return F.coalesce(power, F.lit(10.0) / level0) / F.lit(float(magnification)) * level0


def base_tile_size(tile: int, level0: Column, power: Column, magnification: float) -> Column:
    """Side of a tile in base pixels: at least 1, rounded half to even; an unknown spacing counts as 0.5."""
    known = F.coalesce(level0, F.lit(0.5))
    return F.greatest(F.lit(1), F.rint(F.lit(float(tile)) * (target_spacing(known, power, magnification) / known))).cast("int")


def pyramid_level(downsamples: Column, desired: Column) -> Column:
    """Index of the level whose downsample is nearest to the desired one by ratio; the first of equals."""
    errors = F.transform(downsamples, lambda d, i: F.struct(F.abs(F.log(d / desired)).alias("e"), i.alias("i")))
    return F.array_min(errors)["i"]


def level_within(widths: Column, heights: Column, most: int) -> Column:
    """Index of the largest level whose sides are within a bound, else the last level."""
    fit = F.filter(F.transform(widths, lambda w, i: F.when(F.greatest(w, F.get(heights, i)) <= most, i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_min(fit), F.size(widths) - 1)


def downsamples(widths: Column) -> Column:
    return F.transform(widths, lambda w: F.get(widths, F.lit(0)) / w)


def grid_index(base: Column, stride: int) -> Column:
    if stride <= 0:
        raise ValueError("stride must be positive")
    return F.floor(base / F.lit(stride)).cast("int")


def quality(tissue: Column, artifact: Column) -> Column:
    return F.greatest(F.lit(0.0), tissue * (1 - artifact))


def tile_weight(tissue: Column, artifact: Column) -> Column:
    return clip(tissue * (1 - F.coalesce(artifact, F.lit(0.0))), 0.0, 1.0)


def novelty(similarity: Column, alpha: float, eps: float) -> Column:
    """Weight of a candidate that resembles the history by `similarity`."""
    if alpha <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(max(eps, 0.0)) + clip(1 - similarity, 0.0, 1.0), F.lit(float(alpha)))


def square_iou(ai: Column, aj: Column, bi: Column, bj: Column, size: int) -> Column:
    """Intersection over union of two squares of the same size."""
    inter = F.greatest(F.lit(0), size - F.abs(ai - bi)) * F.greatest(F.lit(0), size - F.abs(aj - bj))
    return inter / (F.lit(2.0 * size * size) - inter)


def posterised(values: Column, step: float) -> Column:
    return F.transform(values, lambda x: F.rint(x / F.lit(step)) * F.lit(step))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """8-bit grey value, rounded half up."""
    return F.floor(r * 0.299 + g * 0.587 + b * 0.114 + 0.5).cast("int")


def saturation(r: Column, g: Column, b: Column) -> Column:
    """8-bit saturation."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top > 0, F.floor((top - low) * 255.0 / top + 0.5)).otherwise(F.lit(0)).cast("int")


def momentum(step: Column, total: int, start: float, end: float) -> Column:
    """Linear ramp from start to end over total steps, clamped to its ends."""
    if total <= 1:
        return F.lit(float(end))
    return F.lit(start) + F.lit(end - start) * clip(step / F.lit(float(total - 1)), 0.0, 1.0)


def cosine_rate(step: Column, total: int, warm_up: int) -> Column:
    """Share of the base rate: a linear warm-up of at least one step, then half a cosine."""
    if total <= 1:
        return F.lit(1.0)
    warm_up = max(1, warm_up)
    after = F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * ((step - warm_up) / F.lit(float(max(1, total - warm_up))))))
    return F.when(step < warm_up, (step + 1) / F.lit(float(warm_up))).otherwise(after)


def checked_percentile(value: float | None) -> float | None:
    """A percentile setting: None or not positive means off; over 100 is an error."""
    if value is None or value <= 0:
        return None
    if value > 100:
        raise ValueError("a percentile is at most 100")
    return float(value)


def sincos_position(i: Column, j: Column, width: int) -> Column:
    """2-D sine-cosine position code of `width` numbers: a half for each axis."""
    quarter = width // 4
    rates = F.array(*[F.lit(1.0 / 10000 ** (k / quarter)) for k in range(quarter)])
    axis = lambda p: F.concat(F.transform(rates, lambda r: F.sin(p * r)), F.transform(rates, lambda r: F.cos(p * r)))
    return F.concat(axis(i), axis(j))
