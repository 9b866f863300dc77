"""Names, labels and preview classes for files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null

# Image types a browser shows as they are.
BROWSER_IMAGES = (
    "image/png",
    "image/jpeg",
    "image/gif",
    "image/webp",
    "image/bmp",
    "image/vnd.microsoft.icon",
    "image/avif",
)

# Types shown as decoded text.
SHOWN_AS_TEXT = (
    "text/plain",
    "text/html",
    "application/xml",
    "text/csv",
    "application/json",
    "text/calendar",
)

# Types that may be sent inline, beside every image.
INLINE_TYPES = ("application/pdf", "text/plain", "application/xml")

DIGEST = "^[0-9a-f]{64}\\z"
NAME_CHARS = 120
STEM_CHARS = 12
LABEL_CHARS = 5


def effective_type(sniffed: Column, declared: Column) -> Column:
    return F.coalesce(sniffed, declared, F.lit(""))


def preview_class(kind: Column) -> Column:
    """How a file can be shown: pdf, image, converted, text or none."""
    return (
        F.when(kind == "application/pdf", "pdf")
        .when(kind.isin(*BROWSER_IMAGES), "image")
        .when(F.startswith(kind, F.lit("image/")), "converted")
        .when(kind.isin(*SHOWN_AS_TEXT), "text")
        .otherwise("none")
    )


def inline_safe(sniffed: Column) -> Column:
    return F.coalesce(
        F.startswith(sniffed, F.lit("image/")) | sniffed.isin(*INLINE_TYPES), F.lit(False)
    )


def is_digest(col: Column) -> Column:
    return F.coalesce(col.rlike(DIGEST), F.lit(False))


def blob_path(sha256: Column) -> Column:
    return F.concat(F.substring(sha256, 1, 2), F.lit("/"), sha256)


def attachment_name(decoded: Column, content_id: Column, sha256: Column, ext: Column) -> Column:
    """Declared name, else the Content-ID's stem with the detected extension."""
    local = F.substring_index(F.btrim(content_id, F.lit("<>")), "@", 1)
    stem = F.coalesce(blank_to_null(local), F.substring(sha256, 1, STEM_CHARS))
    by_id = F.concat(stem, F.coalesce(F.concat(F.lit("."), ext), F.lit("")))
    return F.coalesce(decoded, F.when(content_id.isNotNull(), by_id))


def download_name(filename: Column, sha256: Column, ext: Column) -> Column:
    """A name safe to put in a header: printable, no quotes or slashes, 120 characters."""
    stem = F.substring(sha256, 1, STEM_CHARS)
    fallback = F.concat(stem, F.lit("."), F.coalesce(blank_to_null(ext), F.lit("bin")))
    name = F.coalesce(blank_to_null(filename), fallback)
    # Python's isprintable(): nothing of the classes Other and Separator but the space.
    safe = F.regexp_replace(name, r'[\p{C}\p{Z}"\\/&&[^ ]]', "")
    return F.coalesce(blank_to_null(F.substring(safe, 1, NAME_CHARS)), stem)


def extension_label(ext: Column, filename: Column) -> Column:
    last = F.element_at(F.split(filename, r"\."), -1)
    label = F.coalesce(blank_to_null(ext), blank_to_null(last), F.lit("bin"))
    return F.upper(F.substring(label, 1, LABEL_CHARS))
