"""Image checks and geometry on bytes and measured columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest file, sides of an image, pixels of a bomb.
MOST_BYTES, LEAST_SIDE, MOST_SIDE, MOST_PIXELS = 15 * 1024 * 1024, 320, 4096, 4096 * 4096


#: Parts of a picture that a query can be: all of it, its centre, or a detector's box with so much padding.
CROP_PADDING = {"crop_00": 0.0, "crop_10": 0.10, "crop_15": 0.15, "crop_20": 0.20}
REGIONS = ("full_image", "centre_70", *CROP_PADDING)


def detect_format(content: Column) -> Column:
    at = lambda a, n: F.hex(F.substring(content, a, n))
    found = F.when(at(1, 3) == "FFD8FF", "JPEG").when(at(1, 4) == "89504E47", "PNG").when((at(1, 4) == "52494646") & (at(9, 4) == "57454250"), "WEBP")
    return F.when(F.length(content) >= 12, found.when(F.substring(content, 5, 4).cast("string").isin("ftyp", "HEIC", "heic", "heis", "hevc"), "HEIC"))


def quality_warning(mean: Column, std: Column, std_blurred: Column) -> Column:
    """In this order, so a black image is uniform before it is dark."""
    return F.when(std < 8, "image_too_uniform").when(mean > 240, "overexposed").when(mean < 15, "underexposed").when(F.abs(std - std_blurred) * 10 < 100, "blurry")


def validate(n_bytes: Column, fmt: Column, width: Column, height: Column, mean: Column, std: Column, std_blurred: Column) -> Column:
    """``struct(valid, error, warning, http_status, width, height)`` by the first check that fails."""
    scale = F.when(F.greatest(width, height) > MOST_SIDE, F.lit(float(MOST_SIDE)) / F.greatest(width, height)).otherwise(F.lit(1.0))
    w, h = F.floor(width * scale), F.floor(height * scale)
    quality = quality_warning(mean, std, std_blurred)
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    error = (
        F.when(n_bytes > MOST_BYTES, "file_too_large").when(fmt.isNull(), "unsupported_format").when(width * height > 2 * MOST_PIXELS, "decompression_bomb")
        .when((width < LEAST_SIDE) | (height < LEAST_SIDE), F.concat(F.lit("image_too_small: "), size, F.lit(f" minimum {LEAST_SIDE}x{LEAST_SIDE}")))
        .when(quality == "image_too_uniform", "image_too_uniform: No part visible - please retake photo")
    )
    status = F.when(n_bytes > MOST_BYTES, 413).when(fmt.isNull(), 415).when(width * height > 2 * MOST_PIXELS, 413).when(error.isNotNull(), 422)
    warning = F.concat_ws(", ", F.when(F.greatest(w, h) / F.least(w, h) > 5, "extreme_aspect_ratio"), F.when(quality.isin("overexposed", "underexposed", "blurry"), F.concat(F.lit("low_image_quality:"), quality)))
    return F.struct(error.isNull().alias("valid"), error.alias("error"), F.when(error.isNull(), F.nullif(warning, F.lit(""))).alias("warning"), status.alias("http_status"), w.alias("width"), h.alias("height"))


def adaptive_params(brightness: Column, contrast: Column, noise: Column) -> Column:
    """``struct(denoise, strength, contrast, brightness, sharpen)`` of the processing that measured values ask for."""
    dark, bright, low, high = brightness < 60, brightness > 200, contrast < 30, contrast > 80
    strength = F.when((noise > 10) & ~dark, "strong").when(dark, "medium").when(bright, "light").when(low, "medium").when(high, "light").otherwise("medium")
    return F.struct((~dark).alias("denoise"), strength.alias("strength"), F.when(dark, 1.5).when(bright, 1.0).when(low, 1.4).when(high, 1.0).otherwise(1.2).alias("contrast"), F.when(dark, 30).when(bright, -20).otherwise(0).alias("brightness"), dark.alias("sharpen"))


def centre_crop(width: Column, height: Column, fraction: float = 0.7) -> Column:
    left, top = (width - width * fraction) / 2, (height - height * fraction) / 2
    return F.struct(left.alias("left"), top.alias("top"), (width - left).alias("right"), (height - top).alias("bottom"))


def box_crop(width: Column, height: Column, x1: Column, y1: Column, x2: Column, y2: Column, padding: float | Column) -> Column:
    """The padded square around a box, clipped at the image, and the side it is letterboxed to."""
    bw, bh = x2 - x1, y2 - y1
    side = F.greatest(bw + 2 * F.floor(bw * padding), bh + 2 * F.floor(bh * padding))
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    return F.struct(F.greatest(F.lit(0.0), cx - side / 2).alias("left"), F.greatest(F.lit(0.0), cy - side / 2).alias("top"), F.least(width.cast("double"), cx + side / 2).alias("right"), F.least(height.cast("double"), cy + side / 2).alias("bottom"), side.cast("int").alias("side"))


def query_region(region: Column, width: Column, height: Column, box: Column) -> Column:
    """``struct(left, top, right, bottom, detected)`` of a query's picture that a region is; box: array of x1, y1, x2, y2 or null,
    and then crops are the whole picture."""
    padding = F.coalesce(*[F.when(region == name, F.lit(x)) for name, x in CROP_PADDING.items()])
    cropped = padding.isNotNull() & box.isNotNull()
    centre, crop = centre_crop(width, height), box_crop(width, height, box[0], box[1], box[2], box[3], padding)
    whole = {"left": F.lit(0.0), "top": F.lit(0.0), "right": width.cast("double"), "bottom": height.cast("double")}
    side = lambda c: F.when(region == "centre_70", centre[c].cast("double")).when(cropped, crop[c].cast("double")).otherwise(whole[c])
    return F.struct(*[side(c).alias(c) for c in whole], F.coalesce(cropped, F.lit(False)).alias("detected"))


def analysis_flags(brightness: Column, contrast: Column, noise: Column) -> Column:
    """``struct(is_dark, is_bright, is_low_contrast, is_high_contrast, is_noisy)`` of a picture's measures."""
    return F.struct((brightness < 60).alias("is_dark"), (brightness > 200).alias("is_bright"), (contrast < 30).alias("is_low_contrast"), (contrast > 80).alias("is_high_contrast"), (noise > 10).alias("is_noisy"))
