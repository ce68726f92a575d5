"""Colour arithmetic as column functions.

NaN is handled before every clamp: Spark orders NaN above all numbers, so ``greatest`` and
``least`` alone would turn it into the upper bound.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rimlight.model import (
    CENTRE_SHARE,
    EDGE_SHARE,
    GREY_WEIGHTS,
    LUMA_WEIGHTS,
    MIN_PIXEL_WEIGHT,
    Tuning,
)


def clampf(value: Column, low: float, high: float) -> Column:
    """Clamp to a range; NaN becomes the lower bound."""
    return F.when(F.isnan(value), F.lit(low)).otherwise(
        F.greatest(F.lit(low), F.least(F.lit(high), value)))


def clamp_byte(value: Column) -> Column:
    """Half-even rounding to 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(value, 0).cast("int")))


def grey(r: Column, g: Column, b: Column) -> Column:
    kr, kg, kb = GREY_WEIGHTS
    return r * F.lit(kr) + g * F.lit(kg) + b * F.lit(kb)


def edge_magnitude(gx: Column, gy: Column) -> Column:
    return F.sqrt(gx * gx + gy * gy)


def center_weight(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Gaussian weight of a pixel at zone offset (x, y)."""
    sigma = F.greatest(F.least(width, height) / F.lit(4.0), F.lit(1.0))
    dx = x - F.floor(width / F.lit(2))
    dy = y - F.floor(height / F.lit(2))
    return F.exp(-(dx * dx + dy * dy).cast("double") / (F.lit(2.0) * sigma * sigma))


def pixel_weight(edge: Column, centre: Column) -> Column:
    return F.greatest(
        edge * F.lit(EDGE_SHARE) + centre * F.lit(CENTRE_SHARE), F.lit(MIN_PIXEL_WEIGHT))


def luma_points(r: Column, g: Column, b: Column) -> Column:
    """Luminance in ten-thousandths: whole numbers, so sums do not depend on their order."""
    kr, kg, kb = LUMA_WEIGHTS
    return (r.cast("long") * kr + g.cast("long") * kg + b.cast("long") * kb)


def white_extract(r: Column, g: Column, b: Column) -> Column:
    """(r, g, b) with the common part moved into a white channel."""
    w = F.least(r, g, b)
    return F.struct((r - w).alias("r"), (g - w).alias("g"), (b - w).alias("b"), w.alias("w"))


def adaptive_gamma(lum: Column, gamma: float) -> Column:
    return clampf(F.lit(gamma) * (F.lit(1.0) - lum / F.lit(255.0) * F.lit(0.6)), 1.0, 3.0)


def brightness_factor(lum: Column, target: float) -> Column:
    """Gain of a frame before the final clamp that ``tune_color`` applies."""
    gain = F.lit(max(1.0, target)) / lum * F.lit(0.7) + F.lit(0.3)
    return F.when(lum > 1.0, clampf(gain, 0.05, 2.5)).otherwise(F.lit(1.0))


def tune_color(r: Column, g: Column, b: Column, lum: Column, tuning: Tuning) -> Column:
    """Channel gamma, saturation about the mean, inverse gamma, gain: struct of doubles."""
    inv = F.lit(1.0) / adaptive_gamma(lum, tuning.gamma)
    gain = clampf(brightness_factor(lum, tuning.brightness_target), 0.3, 1.8)
    gammas = (tuning.gamma_red, tuning.gamma_green, tuning.gamma_blue)
    linear = [
        F.pow(clampf(c / F.lit(255.0), 0.0, 1.0), F.lit(gamma))
        for c, gamma in zip((r, g, b), gammas)
    ]
    mean = (linear[0] + linear[1] + linear[2]) / F.lit(3.0)
    sat = F.lit(min(max(tuning.saturation, 0.0), 5.0))

    def finish(channel: Column) -> Column:
        mixed = mean + (channel - mean) * sat
        # a negative base has no real power: NaN, which the clamp turns into 0
        power = F.when(mixed < 0, F.lit(float("nan"))).otherwise(F.pow(mixed, inv))
        return clampf(power, 0.0, 1.0) * gain * F.lit(255.0)

    return F.struct(*[finish(c).alias(n) for c, n in zip(linear, ("r", "g", "b"))])


def floor_and_blackout(r: Column, g: Column, b: Column, tuning: Tuning) -> Column:
    """Smoothed channels to output bytes: round, lift to the floor, blank dim lights."""
    min_b = max(0.0, tuning.min_led_brightness)
    boosts = (tuning.red_boost, tuning.green_boost, tuning.blue_boost)

    def lift(channel: Column, boost: float) -> Column:
        value = F.bround(channel, 0)
        low = F.lit(min_b * boost)
        return F.when((value > 0) & (value < low), low).otherwise(value)

    lifted = [lift(c, boost) for c, boost in zip((r, g, b), boosts)]
    kr, kg, kb = (w / 10_000 for w in LUMA_WEIGHTS)
    dim = lifted[0] * F.lit(kr) + lifted[1] * F.lit(kg) + lifted[2] * F.lit(kb) < F.lit(min_b * 0.5)
    return F.struct(*[
        F.when(dim, F.lit(0)).otherwise(clamp_byte(c)).alias(n)
        for c, n in zip(lifted, ("r", "g", "b"))
    ])
