"""Number and geometry expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, cut toward zero."""
    return (seconds * 1000).cast("bigint")


def to_seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def frame_to_seconds(frame: Column, fps: float) -> Column:
    return frame / F.lit(float(fps))


def seconds_to_frame(seconds: Column, fps: float, cut: bool = False) -> Column:
    """The nearest frame (halves to even), or the frame begun."""
    x = seconds * F.lit(float(fps))
    return x.cast("bigint") if cut else F.bround(x, 0).cast("bigint")


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the common part, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_share(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common part as a share of the first interval; null if that has no length."""
    return F.when(e1 > s1, overlap(s1, e1, s2, e2) / (e1 - s1))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def signed_mean(left: Column, right: Column) -> Column:
    """Mean magnitude of two angles with the sign of their sum; a zero sum counts as positive."""
    return (F.abs(left) + F.abs(right)) / 2 * F.when(left + right < 0, -1.0).otherwise(1.0)


def angle_bin(angle: Column, step: float) -> Column:
    return F.floor(F.abs(angle) / F.lit(float(step)))


def third_of_frame(x: Column, w: Column) -> Column:
    """0, 1 or 2: the third of a frame that a box's centre lies in."""
    return F.least(F.floor((x + w / 2) * 3), F.lit(2))


def box_from_pixels(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Normalised x, y, w, h of pixel corners, rounded to whole pixels and not below zero."""
    at = lambda v: F.greatest(F.bround(v, 0), F.lit(0.0))
    return F.struct(
        (at(x1) / width).alias("x"), (at(y1) / height).alias("y"), ((at(x2) - at(x1)) / width).alias("w"), ((at(y2) - at(y1)) / height).alias("h")
    )


def box_to_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """Pixel corners of a normalised box, cut to whole numbers."""
    return tuple(v.cast("int") for v in (x * width, y * height, (x + w) * width, (y + h) * height))


def square_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, scale: float = 0.4) -> Column:
    """Corners of the square about a box with a margin, inside the frame."""
    half = F.greatest(x2 - x1, y2 - y1) / 2 * (1 + scale)
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    zero = F.lit(0.0)
    return F.struct(
        F.greatest(zero, cx - half).alias("x1"), F.greatest(zero, cy - half).alias("y1"), F.least(width, cx + half).alias("x2"), F.least(height, cy + half).alias("y2")
    )


def resize_scale(width: Column, height: Column, most: float) -> Column:
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))


def gaussian(x: Column, bandwidth: float) -> Column:
    return F.exp(-(x * x) / F.lit(2.0 * bandwidth * bandwidth))


# -- positions ---------------------------------------------------------------


def linspace(a: Column, b: Column, n: Column) -> Column:
    """``n`` values from a to b, both ends included; one value is a."""
    gaps = F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: a + i * (b - a) / gaps)


def linspace_index(a: Column, b: Column, n: Column, nearest: bool = False) -> Column:
    """The same as whole numbers, cut or rounded half to even."""
    return F.transform(linspace(a.cast("double"), b.cast("double"), n), lambda v: (F.bround(v, 0) if nearest else v).cast("int"))


def resampled_frames(total: Column, fps_in: Column, fps_out: float) -> Column:
    """Frame numbers that resample ``total`` frames to another rate; none where no frame is left."""
    n = (total * F.lit(float(fps_out)) / fps_in).cast("int")
    return F.when(n > 0, linspace_index(F.lit(0), total - 1, n)).otherwise(F.array().cast("array<int>"))


def one_a_second(total: Column, fps: Column) -> Column:
    """0, fps, 2 fps, ... below ``total``, fps cut to a whole number of at least one."""
    step = F.greatest(F.floor(fps).cast("int"), F.lit(1))
    return F.when(total > 0, F.sequence(F.lit(0), total.cast("int") - 1, step)).otherwise(F.array().cast("array<int>"))


def strided(start: Column, end: Column, step: Column) -> Column:
    """start, start + step, ... up to ``end``, both included; none if start is past the end."""
    return F.when(start <= end, F.sequence(start, end, step)).otherwise(F.array().cast("array<int>"))


def strided_capped(start: Column, end: Column, fps: int, most: int = 32) -> Column:
    """Every quarter second from start up to but not including end; above ``most`` frames, that many spread evenly."""
    taken = strided(start, end - 1, F.lit(max(1, fps // 4)))
    n = F.size(taken)
    return F.when(n > most, F.transform(linspace_index(F.lit(0), n - 1, F.lit(most)), lambda i: F.get(taken, i))).otherwise(taken)


def spread(start: Column, end: Column, n: int) -> Column:
    """All frames if there are at most ``n``, else ``n`` spread evenly, ends included."""
    return F.when(end - start + 1 <= n, strided(start, end, F.lit(1))).otherwise(linspace_index(start, end, F.lit(n)))


def clip_indices(frames: Column, length: int) -> Column:
    """A fixed number of frames: the last repeated where too few, else every k-th from the first."""
    n = F.size(frames)
    step = F.greatest(F.floor(n / length).cast("int"), F.lit(1))
    short = F.concat(frames, F.array_repeat(F.element_at(frames, -1), F.greatest(F.lit(length) - n, F.lit(0))))
    picked = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(frames, i * step))
    return F.when(n < length, short).otherwise(picked)


def hash_index(seed: Column, n: Column) -> Column:
    """A whole number from 0 to below ``n``, the same for the same seed everywhere: 48 bits of its MD5."""
    return F.conv(F.substring(F.md5(seed.cast("string")), 1, 12), 16, 10).cast("long") % n
