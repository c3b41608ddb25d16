"""Path expressions: folders, extensions, page paths, thumbnail names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DOCUMENTS, IMAGES, VIDEOS


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def media_type(path: Column) -> Column:
    """image, video or document by extension; null for anything else."""
    e = extension(path)
    return F.when(e.isin(IMAGES), "image").when(e.isin(VIDEOS), "video").when(e.isin(DOCUMENTS), "document")


def is_supported(path: Column, kinds=("image", "video", "document")) -> Column:
    return F.coalesce(media_type(path).isin(list(kinds)), F.lit(False))


def trimmed(folder: str) -> str:
    return folder.rstrip("/\\")


def under(path: Column, folder: str, recursive: bool = True) -> Column:
    """Whether a path lies in a folder: anywhere below, or as a direct child."""
    root = trimmed(folder)
    inside = F.startswith(path, F.lit(root + "/"))
    if recursive:
        return inside
    return inside & (F.instr(F.substring(path, len(root) + 2, 1 << 30), "/") == 0)


def under_legacy(path: Column, folder: str) -> Column:
    """Prefix without a separator, ASCII case ignored."""
    root = trimmed(folder).lower()
    return F.startswith(F.lower(path), F.lit(root))


def page_path(document: Column, page: Column) -> Column:
    return F.concat(document, F.lit("#page="), page.cast("string"))


def page_of(path: Column) -> Column:
    """The page number of a page path, by its last mark; null for other paths."""
    return F.try_to_number(F.nullif(F.regexp_extract(path, r"#page=(\d+)$", 1), F.lit("")), F.lit("9999999999")).cast("int")


def document_of(path: Column) -> Column:
    return F.when(page_of(path).isNotNull(), F.regexp_extract(path, r"^(.*)#page=\d+$", 1))


def thumbnail_name(path: Column) -> Column:
    return F.concat(F.substring(F.md5(path), 1, 16), F.lit(".jpg"))


def fast_hash(size: Column, mtime: Column) -> Column:
    """Size and modification time in microseconds."""
    return F.concat_ws("_", size, F.unix_micros(mtime))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_-]", "")
