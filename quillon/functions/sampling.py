"""Which frames, pages and pixels to take: expressions over integer columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FRAME_PIXELS, THUMBNAIL_SIDE


def uniform_indices(total: Column, most: int, least: int = 1) -> Column:
    """Evenly spread frame numbers from the first to the last, cut to whole numbers."""
    n = F.greatest(F.least(F.lit(most), total), F.least(F.lit(least), total))
    step = (total - 1).cast("double") / (n - 1)
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == n - 1, total - 1).otherwise((i * step).cast("int")))
    return F.when(total <= 0, F.array().cast("array<int>")).when(n == 1, F.array(F.lit(0))).otherwise(spread)


def fps_indices(total: Column, fps: Column, target: float, most: int) -> Column:
    """Every frame at the target rate from the start on, at most so many."""
    step = F.greatest(F.lit(1), (fps / target).cast("int"))
    return F.when(total > 0, F.slice(F.sequence(F.lit(0), total - 1, step), 1, most)).otherwise(F.array().cast("array<int>"))


def padded(indices: Column, least: int) -> Column:
    """Repeat the last one up to a least number; nothing stays nothing."""
    short = F.greatest(F.lit(least) - F.size(indices), F.lit(0))
    return F.when(F.size(indices) > 0, F.concat(indices, F.array_repeat(F.try_element_at(indices, F.lit(-1)), short))).otherwise(indices)


def keyframe_index(total: Column) -> Column:
    return F.greatest(F.lit(0), F.least((total * 0.1).cast("int"), total - 1))


def duration(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(0.0)


def pages(count: Column, most: int) -> Column:
    """Page numbers from 1."""
    return F.when(count > 0, F.sequence(F.lit(1), F.least(count, F.lit(most)))).otherwise(F.array().cast("array<int>"))


def thumbnail_size(width: Column, height: Column, side: int = THUMBNAIL_SIDE) -> Column:
    """Longest side at most ``side``; never larger than before."""
    scaled = lambda a, b: (a * (F.lit(float(side)) / b)).cast("int")
    small = (width <= side) & (height <= side)
    w = F.when(small, width).when(width > height, side).otherwise(scaled(width, height))
    h = F.when(small, height).when(width > height, scaled(height, width)).otherwise(side)
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))


def frame_size(width: Column, height: Column, pixels: int = FRAME_PIXELS, unit: int = 28) -> Column:
    """A frame over the pixel budget shrinks to it, to multiples of the unit."""
    scale = F.sqrt(F.lit(float(pixels)) / (width * height))
    cut = lambda x: F.greatest(F.lit(unit), F.floor((x * scale).cast("int") / unit).cast("int") * unit)
    over = width * height > pixels
    return F.struct(F.when(over, cut(width)).otherwise(width).cast("int").alias("width"), F.when(over, cut(height)).otherwise(height).cast("int").alias("height"))


def codec_name(fourcc: Column) -> Column:
    return F.concat(*[F.chr(F.shiftright(fourcc, 8 * i).bitwiseAND(F.lit(255)).cast("long")) for i in range(4)])


def centred(width: Column, height: Column, side: int = THUMBNAIL_SIDE) -> Column:
    """A page's thumbnail (see ``thumbnail_size``) in the middle of a square: x, y, width, height."""
    size = thumbnail_size(width, height, side)
    middle = lambda x: F.floor((F.lit(side) - x) / 2).cast("int")
    return F.struct(middle(size.width).alias("x"), middle(size.height).alias("y"), size.width.alias("width"), size.height.alias("height"))


def page_badge(page: Column) -> Column:
    """What is written on the thumbnail of a page behind the first; null on the first."""
    return F.when(page > 1, F.concat(F.lit("p."), page.cast("string")))


def frame_rows(videos: DataFrame, indices: Column) -> DataFrame:
    """videos (path, others) as a row a frame to be read: path, pos, frame."""
    return videos.select("path", F.posexplode(indices).alias("pos", "frame"))
