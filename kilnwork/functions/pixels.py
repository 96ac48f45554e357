"""Integer arithmetic on channels and residuals, as column expressions.

``div`` truncates toward zero and ``shiftright`` floors; both are used on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero; null for a zero divisor."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long")))


def premultiply(channel: Column, alpha: Column) -> Column:
    return div(channel * alpha + 127, 255)


def unpremultiply(channel: Column, alpha: Column) -> Column:
    """Straight channel, at most 255; 0 where alpha is 0."""
    return F.when(alpha == 0, F.lit(0).cast("long")).otherwise(F.least(div(channel * 255 + div(alpha, 2), alpha), F.lit(255).cast("long")))


def fold(residual: Column) -> Column:
    """Sign in the lowest bit: negative d gives -2d + 1, others 2d."""
    return F.when(residual < 0, -residual * 2 + 1).otherwise(residual * 2)


def unfold(code: Column) -> Column:
    return F.when(code % 2 == 1, -div(code, 2)).otherwise(div(code, 2))


def gradient_choice(left: Column, up: Column, corner: Column) -> Column:
    """Left where it is at least as near to the corner across the edge, else up."""
    return F.when(F.abs(up - corner) <= F.abs(left - corner), left).otherwise(up)


def mean_floor(left: Column, up: Column) -> Column:
    return F.shiftright(left + up + 1, 1)


def clamp8(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0).cast("long")), F.lit(255).cast("long"))


def rgb_of(y: Column, c1: Column, c2: Column) -> tuple[Column, Column, Column]:
    """Inverse colour transform, clamped to 8 bits."""
    return clamp8(y - c1 - c2), clamp8(y + c2), clamp8(y + c1 - c2)


def quantize8(value: Column) -> Column:
    """[0, 1] to 8 bits, half up; NaN to 0 (least and greatest would keep it largest)."""
    clamped = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return F.when(F.isnan(value), 0).otherwise(F.floor(clamped * 255 + 0.5)).cast("long")


def round_up(value: Column, step: int) -> Column:
    return div(value.cast("long") + (step - 1), step) * step


#: What the counts below give for samples of different lengths.
UNEQUAL_LENGTHS = -1


def samples_over(a: Column, b: Column, tolerance: float) -> Column:
    """How many samples of two arrays differ by more than the tolerance; UNEQUAL_LENGTHS where they can't be compared."""
    apart = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    n = F.size(F.filter(apart, lambda d: d > tolerance)).cast("long")
    return F.when(F.size(a) == F.size(b), n).otherwise(F.lit(UNEQUAL_LENGTHS))


def pixels_over(a: Column, b: Column, tolerance: float, channels: int = 4) -> Column:
    """As samples_over, but a pixel of several channels counts once."""
    apart = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")) > tolerance)
    places = F.when(F.size(apart) >= channels, F.sequence(F.lit(0), div(F.size(apart), channels).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    n = F.size(F.filter(places, lambda k: F.exists(F.slice(apart, k * channels + 1, channels), lambda over: over))).cast("long")
    return F.when(F.size(a) == F.size(b), n).otherwise(F.lit(UNEQUAL_LENGTHS))
