"""Filtered, sorted, paged listings of an occurrence view."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.names import effective_type
from ..functions.text import like_ascii
from ..sources.scratch import scratch
from .dedup import (
    OCCURRENCE_KEY,
    digest_counts,
    only_duplicated,
    representatives,
    with_copies,
)
from .paging import SortKey, page_after, page_in_order, write_order

PAGE_SIZE = 120

# Folders left out of a listing unless asked for.
NOISE_FOLDERS = (".reports.dmarc", ".Junk", ".Spam", ".Trash", ".Deleted Messages")

DIRECTIONS = ("in", "out", "unknown")
SEARCHED = ("filename", "subject", "from_raw", "to_raw")

# kind=other is what none of these covers.
NAMED_KINDS = ("image/", "application/pdf", "application/zip")

LISTED = (
    "maildir_path",
    "part_path",
    "sha256",
    "filename",
    "mime_declared",
    "sniffed_type",
    "sniffed_ext",
    "size",
    "folder",
    "direction",
    "subject",
    "from_raw",
    "to_raw",
    "decode_failed",
    "date_parsed",
)

# A page this far down is found by counting sorted partitions, because keeping
# every row above it in each task would not be a top-k any more.
DEEP_ROWS = 20_000


@dataclass(frozen=True)
class BrowseParams:
    """What a reader asked for. Fields left None do not filter."""

    q: str | None = None
    direction: str | None = None
    year: str | None = None
    folder: str | None = None
    kind: str | None = None
    minsize: int | None = None
    noise: bool = False
    noise_folders: tuple[str, ...] = NOISE_FOLDERS
    sha: str | Column | None = None  # a digest, or a column of one value for all rows
    dupes: bool = False
    collapse: bool = True
    sort: str = "date"
    page: int = 0

    @classmethod
    def from_form(cls, form: Mapping[str, str], **defaults) -> BrowseParams:
        """Read text fields as submitted; a value that makes no sense is dropped."""
        return cls(
            q=form.get("q") or None,
            direction=form.get("direction") if form.get("direction") in DIRECTIONS else None,
            year=form.get("year") or None,
            folder=form.get("folder") or None,
            kind=form.get("kind") or None,
            minsize=_whole(form.get("minsize")),
            noise=form.get("noise") == "1",
            sha=_digest(form.get("sha")),
            dupes=form.get("dupes") == "1",
            collapse=form.get("collapse", "1") == "1",
            sort=form.get("sort", "date"),
            page=max(0, _whole(form.get("page")) or 0),
            **defaults,
        )

    @classmethod
    def copies_of(cls, sha: str) -> BrowseParams:
        """Every copy of one file, oldest first, wherever it lies."""
        return cls(sha=sha, noise=True, collapse=False, sort="oldest")


def _whole(value: str | None) -> int | None:
    try:
        return int(value) if value else None
    except ValueError:
        return None


def _digest(value: str | None) -> str | None:
    if not value or len(value) != 64 or set(value) - set("0123456789abcdef"):
        return None
    return value


def conditions(params: BrowseParams) -> list[Column]:
    """One condition per field that is set, all but ``dupes``, which needs a join."""
    found = []
    if params.q:
        hits = [like_ascii(F.col(c), f"%{params.q}%") for c in SEARCHED]
        found.append(reduce(lambda a, b: a | b, hits))
    if params.direction:
        found.append(F.col("direction") == params.direction)
    if params.year:
        found.append(F.col("year") == params.year)
    if params.folder:
        found.append(F.col("folder") == params.folder)
    if params.kind:
        kind = effective_type(F.col("sniffed_type"), F.col("mime_declared"))
        if params.kind == "other":
            found += [~like_ascii(kind, named + "%") for named in NAMED_KINDS]
        else:
            found.append(like_ascii(kind, params.kind + "%"))
    if params.minsize is not None:
        found.append(F.col("size") >= params.minsize * 1024)
    if not params.folder and not params.noise:
        found.append(~F.col("folder").isin(*params.noise_folders))
    if isinstance(params.sha, Column) or params.sha:
        found.append(F.col("sha256") == params.sha)
    return found


def browse(view: DataFrame, attachments: DataFrame, params: BrowseParams) -> DataFrame:
    """Rows of the view that match; ``attachments`` is what duplicates are counted in."""
    for condition in conditions(params):
        view = view.filter(condition)
    return only_duplicated(view, attachments) if params.dupes else view


def sort_keys(sort: str) -> list[SortKey]:
    """The columns of a sort, down to a row's own key; an unknown sort means newest first."""
    up = [SortKey(c, True) for c in OCCURRENCE_KEY]
    down = [SortKey(c, False) for c in OCCURRENCE_KEY]
    digest = SortKey("sha256", True)
    keys = {
        "date": [SortKey("date_parsed", False), *down],
        "oldest": [SortKey("date_parsed", True), *up],
        "size": [SortKey("size", False), digest, *up],
        "name": [SortKey("filename", True, folded=True), digest, *up],
        "dupes": [SortKey("copies", False), digest, *up],
    }
    return keys.get(sort, keys["date"])


def sort_order(sort: str) -> list[Column]:
    """Total order of a sort."""
    return [key.order() for key in sort_keys(sort)]


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the rows in order, with ``pos`` counting from 1 within the listing."""
    skip = page * size
    if skip + size > DEEP_ROWS:
        return deep_page(rows, order, skip, size)
    top = rows.orderBy(*order).offset(skip).limit(size)
    # The window sees one page at most.
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long") + skip)


def deep_page(rows: DataFrame, order: list[Column], skip: int, size: int) -> DataFrame:
    """A page far down a long listing, without a single task seeing all rows.

    The order is written to be read once. Who turns more such pages keeps it
    (:func:`keep_listing`) or goes on from the last row (``after`` of :func:`listing`).
    """
    path = scratch(rows.sparkSession, "order")
    write_order(rows, order, path)
    return page_in_order(rows.sparkSession, path, skip, size)


def listed_keys(view: DataFrame, attachments: DataFrame, params: BrowseParams) -> DataFrame:
    """The rows of a whole listing, narrowed to the columns that sorts need."""
    rows = browse(view, attachments, params)
    keys = rows.select(*OCCURRENCE_KEY, "sha256", "date_parsed", "size", "filename")
    if params.collapse:
        keys = representatives(keys, "size", "filename")
    if params.sort != "dupes":
        return keys
    if params.collapse:
        # Both sides hold a digest once and are already spread by it.
        return keys.join(digest_counts(attachments), "sha256")
    return with_copies(keys, attachments)


def listing(
    view: DataFrame,
    attachments: DataFrame,
    params: BrowseParams,
    size: int = PAGE_SIZE,
    after: Mapping | None = None,
) -> DataFrame:
    """One page of a listing: filter, collapse, sort, cut, then count copies.

    The representative of a file is chosen among the rows that match, its
    copies are counted among all. Unless the sort needs the counts, they are
    taken for the files of the page alone.

    ``after`` is the last row of a page, as a mapping. The page is then the one that follows it,
    found by its sort key, and the page number doesn't count.
    """
    keys = listed_keys(view, attachments, params)
    if after is None:
        page = page_of(keys, sort_order(params.sort), params.page, size)
    else:
        page = page_after(keys, sort_keys(params.sort), after, size)
    return whole_rows(view, attachments, page, size)


def keep_listing(
    view: DataFrame, attachments: DataFrame, params: BrowseParams, path: str
) -> None:
    """Write the order of a listing to ``path``, a new folder, for :func:`kept_page`.

    It stays what it was when mail comes in; a new one is kept for the new version then.
    """
    keys = listed_keys(view, attachments, params)
    write_order(keys, sort_order(params.sort), path)


def kept_page(
    view: DataFrame, attachments: DataFrame, path: str, page: int, size: int = PAGE_SIZE
) -> DataFrame:
    """A page of a kept listing, however far down, from the few files that hold its keys."""
    keys = page_in_order(view.sparkSession, path, page * size, size)
    return whole_rows(view, attachments, keys, size)


def whole_rows(
    view: DataFrame, attachments: DataFrame, page: DataFrame, size: int
) -> DataFrame:
    """A page's rows with all columns that are listed, fetched for the page alone."""
    known = [c for c in ("pos", "copies") if c in page.columns]
    keys = page.select(*OCCURRENCE_KEY, *known)
    fetched = view.select(*LISTED).join(F.broadcast(keys), list(OCCURRENCE_KEY))
    if "copies" not in known:
        fetched = count_on_page(fetched, attachments)
    return fetched.select(*LISTED, "pos", "copies").orderBy("pos").limit(size)


def count_on_page(page: DataFrame, attachments: DataFrame) -> DataFrame:
    """Add ``copies`` to the rows of a page, which stands once in the plan.

    The page's rows are gathered by digest, at most a page of them, and met by all
    occurrences, or by the kept differences, once; what is left after counting is unfolded again.
    """
    files = page.groupBy("sha256").agg(F.collect_list(F.struct(*page.columns)).alias("rows"))
    kept = "copies" in attachments.columns  # differences, of which there are few for a page
    one = F.col("copies") if kept else F.lit(1).cast("long").alias("copies")
    occurrences = attachments.select("sha256", one).join(F.broadcast(files), "sha256")
    counted = occurrences.groupBy("sha256", "rows").agg(F.sum("copies").alias("copies"))
    return counted.select("copies", F.inline("rows"))


def listing_totals(view: DataFrame, attachments: DataFrame, params: BrowseParams) -> DataFrame:
    """One row (total, pages, bytes) describing the whole listing."""
    rows = browse(view, attachments, params).select("sha256", "size")
    if params.collapse:
        rows = rows.groupBy("sha256").agg(F.max("size").alias("size"))
    total = rows.agg(
        F.count("*").alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )
    pages = F.floor((F.col("total") + PAGE_SIZE - 1) / PAGE_SIZE).cast(T.LongType())
    return total.select("total", pages.alias("pages"), "bytes")


def next_page(params: BrowseParams) -> BrowseParams:
    return replace(params, page=params.page + 1)


def facet_years(view: DataFrame) -> DataFrame:
    """Years present, newest first."""
    years = view.filter(F.col("year").isNotNull()).select("year").distinct()
    return years.orderBy(F.desc("year"))


def facet_folders(view: DataFrame) -> DataFrame:
    """Occurrences per folder, largest first."""
    counts = view.groupBy("folder").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("folder"))


def facet_totals(attachments: DataFrame, blobs: DataFrame, messages: DataFrame) -> DataFrame:
    """One row of archive totals and the bytes deduplication saves.

    Occurrences are counted per digest before they meet the sizes.
    """
    per_file = blobs.select("sha256", "size").join(
        digest_counts(attachments), "sha256", "full_outer"
    )
    zero = F.lit(0).cast("long")
    size = F.coalesce("size", zero)
    copies = F.coalesce("copies", zero)
    files = per_file.agg(
        F.coalesce(F.sum("copies"), zero).alias("occurrences"),
        F.count("size").alias("distinct_blobs"),
        F.coalesce(F.sum("size"), zero).alias("unique_bytes"),
        F.coalesce(F.sum(size * copies), zero).alias("total_bytes"),
        zero.alias("messages"),
    )
    mail = messages.agg(
        *[zero.alias(c) for c in files.columns[:-1]], F.count("*").alias("messages")
    )
    both = files.unionByName(mail).agg(*[F.sum(c).alias(c) for c in files.columns])
    return both.withColumn("saved_bytes", F.col("total_bytes") - F.col("unique_bytes"))
