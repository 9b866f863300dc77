"""Browsing: filters, collapse, copies, sorts, pages, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import browse as b
from ..operators import dedup, search
from ..operators.browse import BrowseParams
from ..sources import corpus
from . import sql
from .registry import query

KEYS = ("maildir_path", "part_path", "sha256")
QUIET = f"folder NOT IN {sql.NOISE}"
KIND = "coalesce(sniffed_type, mime_declared, '')"


def _rows(where: str) -> str:
    return f"WITH {sql.OCC} SELECT maildir_path, part_path, sha256 FROM occ WHERE {where}"


def _filtered(spark, sf_dir, params: BrowseParams) -> DataFrame:
    view = corpus.occurrences(spark, sf_dir)
    return b.browse(view, view, params).select(*KEYS)


def _listed(spark, sf_dir, params: BrowseParams) -> DataFrame:
    view = corpus.occurrences(spark, sf_dir)
    return b.listing(view, view, params)


# --- filters -----------------------------------------------------------------

SEARCH = " OR ".join(
    f"{sql.fold(c)} LIKE '%oc_1_.t%'" for c in ("filename", "subject", "from_raw", "to_raw")
)


@query("filter_search", _rows(f"({SEARCH}) AND {QUIET}"))
def filter_search(spark, sf_dir):
    return _filtered(spark, sf_dir, BrowseParams(q="OC_1_.t"))


FILE_ROWS = 10_000  # rows of a stored file, where there are enough

RARE = " OR ".join(
    f"{sql.fold(c)} LIKE '%eron_th %the%'" for c in ("filename", "subject", "from_raw", "to_raw")
)


@query("filter_search_indexed", _rows(f"({RARE}) AND {QUIET}"))
def filter_search_indexed(spark, sf_dir):
    """The occurrences are stored in several files, with a bitmap of trigrams for each.

    Files follow the beginning of the subject; rows that share it are dealt out by path.
    """
    base = corpus.scratch(spark, "search")
    view = corpus.occurrences(spark, sf_dir)
    files = max(8, view.count() // FILE_ROWS)
    order = F.substring("subject", 1, 64), F.col("maildir_path")
    view.repartitionByRange(files, *order).write.parquet(f"{base}/occurrences")
    stored = spark.read.schema(view.schema).parquet(f"{base}/occurrences")
    search.update_bitmaps(stored, f"{base}/bitmaps")
    bitmaps = spark.read.parquet(f"{base}/bitmaps")
    found = search.search(stored, stored, bitmaps, BrowseParams(q="ERON_th %the"))
    return found.select(*KEYS)


@query("filter_direction", _rows(f"direction = 'unknown' AND {QUIET}"))
def filter_direction(spark, sf_dir):
    return _filtered(spark, sf_dir, BrowseParams(direction="unknown"))


@query("filter_year", _rows(f"year = '2003' AND {QUIET}"))
def filter_year(spark, sf_dir):
    return _filtered(spark, sf_dir, BrowseParams(year="2003"))


@query("filter_folder", _rows("folder = '.Spam'"))
def filter_folder(spark, sf_dir):
    return _filtered(spark, sf_dir, BrowseParams(folder=".Spam"))


@query("filter_kind", _rows(f"{sql.fold(KIND)} LIKE 'text/%' AND {QUIET}"))
def filter_kind(spark, sf_dir):
    return _filtered(spark, sf_dir, BrowseParams(kind="TEXT/"))


@query(
    "filter_kind_other",
    _rows(
        f"{KIND} NOT LIKE 'image/%' AND {KIND} NOT LIKE 'application/pdf%'"
        f" AND {KIND} NOT LIKE 'application/zip%' AND {QUIET}"
    ),
)
def filter_kind_other(spark, sf_dir):
    return _filtered(spark, sf_dir, BrowseParams(kind="other"))


@query("filter_minsize", _rows(f"size >= 2048 AND {QUIET}"))
def filter_minsize(spark, sf_dir):
    return _filtered(spark, sf_dir, BrowseParams.from_form({"minsize": "2"}))


@query("filter_noise", _rows("folder NOT IN ('.Gesendet', '.Spam')"))
def filter_noise(spark, sf_dir):
    return _filtered(spark, sf_dir, BrowseParams(noise_folders=(".Gesendet", ".Spam")))


@query("filter_sha", _rows(f"sha256 = (SELECT min(sha256) FROM occ WHERE {QUIET}) AND {QUIET}"))
def filter_sha(spark, sf_dir):
    """The digest is found by a subquery of one row, in the job that filters by it."""
    lowest = _filtered(spark, sf_dir, BrowseParams()).agg(F.min("sha256"))
    return _filtered(spark, sf_dir, BrowseParams(sha=lowest.scalar()))


DOUBLED = "sha256 IN (SELECT sha256 FROM occ GROUP BY sha256 HAVING count(*) > 1)"


@query("filter_dupes", _rows(f"{DOUBLED} AND {QUIET}"))
def filter_dupes(spark, sf_dir):
    return _filtered(spark, sf_dir, BrowseParams(dupes=True))


@query(
    "browse_combined",
    _rows(
        f"({SEARCH}) AND direction = 'in' AND year >= '0' AND {sql.fold(KIND)} LIKE 'text/%'"
        f" AND size >= 1024 AND folder = '.Archives.2007' AND {DOUBLED} AND year = '2004'"
        f" OR ({SEARCH}) AND direction = 'out' AND {DOUBLED} AND size >= 1024 AND {QUIET}"
    ),
)
def browse_combined(spark, sf_dir):
    view = corpus.occurrences(spark, sf_dir)
    form = {"q": "oc_1_.t", "dupes": "1", "minsize": "1"}
    narrow = form | {"direction": "in", "year": "2004", "kind": "text/", "folder": ".Archives.2007"}
    wide = form | {"direction": "out"}
    found = [b.browse(view, view, BrowseParams.from_form(f)) for f in (narrow, wide)]
    return found[0].unionByName(found[1]).select(*KEYS)


# --- collapse and copies -----------------------------------------------------


@query("collapse", f"WITH {sql.OCC} {sql.collapsed('SELECT * FROM occ')}")
def collapse(spark, sf_dir):
    return dedup.collapse(corpus.occurrences(spark, sf_dir).select(*b.LISTED))


@query(
    "copies",
    f"WITH {sql.OCC} SELECT maildir_path, part_path, sha256,"
    " count(*) OVER (PARTITION BY sha256) AS copies FROM occ",
)
def copies(spark, sf_dir):
    rows = corpus.occurrences(spark, sf_dir).select(*KEYS)
    return dedup.with_copies(rows, rows)


@query(
    "duplicate_digests",
    f"WITH {sql.OCC} SELECT sha256, count(*) AS copies FROM occ GROUP BY sha256"
    " HAVING count(*) > 1",
)
def duplicate_digests(spark, sf_dir):
    return dedup.duplicate_digests(corpus.occurrences(spark, sf_dir))


# --- listings ----------------------------------------------------------------

EVERY = "SELECT * FROM occ"


@query("listing_collapsed", sql.page(sql.collapsed(f"{EVERY} WHERE {QUIET}")))
def listing_collapsed(spark, sf_dir):
    return _listed(spark, sf_dir, BrowseParams())


@query("listing_every_copy", sql.page(f"{EVERY} WHERE {QUIET}"))
def listing_every_copy(spark, sf_dir):
    return _listed(spark, sf_dir, BrowseParams(collapse=False))


@query("page_two", sql.page(sql.collapsed(f"{EVERY} WHERE {QUIET}"), number=1))
def page_two(spark, sf_dir):
    return _listed(spark, sf_dir, BrowseParams(page=1))


@query("page_after", sql.page(f"{EVERY} WHERE {QUIET}", "name", number=1))
def page_after(spark, sf_dir):
    """The second page, found by the sort key of the first one's last row."""
    view = corpus.occurrences(spark, sf_dir)
    params = BrowseParams(collapse=False, sort="name")
    last = b.listing(view, view, params).orderBy(F.desc("pos")).first()
    if last is None:
        return b.listing(view, view, b.next_page(params))
    return b.listing(view, view, params, after=last.asDict())


@query("page_of_kept_order", sql.page(sql.collapsed(EVERY), "size", number=2))
def page_of_kept_order(spark, sf_dir):
    """The third page, from an order that is written once for all pages."""
    view = corpus.occurrences(spark, sf_dir)
    path = corpus.scratch(spark, "order")
    b.keep_listing(view, view, BrowseParams(noise=True, sort="size"), path)
    return b.kept_page(view, view, path, page=2)


def _sort_query(sort: str, collapse_rows: bool) -> None:
    rows = sql.collapsed(EVERY) if collapse_rows else EVERY

    @query(f"sort_{sort}", sql.page(rows, sort))
    def sorted_page(spark, sf_dir):
        params = BrowseParams(noise=True, sort=sort, collapse=collapse_rows)
        return _listed(spark, sf_dir, params)


_sort_query("date", False)
_sort_query("oldest", False)
_sort_query("size", True)
_sort_query("name", False)
_sort_query("dupes", True)


@query(
    "file_provenance",
    f"""WITH {sql.OCC}, top AS (SELECT sha256, count(*) AS copies FROM occ GROUP BY sha256
  ORDER BY count(*) DESC, sha256 LIMIT 1)
SELECT maildir_path, part_path, folder, filename, date_parsed, copies
FROM occ JOIN top USING (sha256)""",
)
def file_provenance(spark, sf_dir):
    """Every copy of the most repeated file, oldest first."""
    view = corpus.occurrences(spark, sf_dir)
    top = dedup.digest_counts(view).orderBy(F.desc("copies"), "sha256").limit(1)
    rows = view.join(F.broadcast(top), "sha256").orderBy(*b.sort_order("oldest"))
    return rows.select(
        "maildir_path", "part_path", "folder", "filename", "date_parsed", "copies"
    )


@query(
    "listing_totals",
    f"WITH {sql.OCC}, files AS (SELECT sha256, max(size) AS size FROM occ WHERE {QUIET}"
    " GROUP BY sha256) SELECT count(*) AS total, CAST((count(*) + 119) // 120 AS BIGINT) AS pages,"
    " CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM files",
)
def listing_totals(spark, sf_dir):
    view = corpus.occurrences(spark, sf_dir)
    return b.listing_totals(view, view, BrowseParams())


@query(
    "listing_totals_every",
    f"WITH {sql.OCC} SELECT count(*) AS total, CAST((count(*) + 119) // 120 AS BIGINT) AS pages,"
    f" CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM occ WHERE {QUIET}",
)
def listing_totals_every(spark, sf_dir):
    view = corpus.occurrences(spark, sf_dir)
    return b.listing_totals(view, view, BrowseParams(collapse=False))


# --- facets ------------------------------------------------------------------


@query("facet_years", f"WITH {sql.OCC} SELECT DISTINCT year FROM occ WHERE year IS NOT NULL")
def facet_years(spark, sf_dir):
    return b.facet_years(corpus.occurrences(spark, sf_dir))


@query("facet_folders", f"WITH {sql.OCC} SELECT folder, count(*) AS n FROM occ GROUP BY folder")
def facet_folders(spark, sf_dir):
    return b.facet_folders(corpus.occurrences(spark, sf_dir))


@query(
    "facet_totals",
    f"""WITH {sql.OCC}, blobs AS (SELECT sha256, max(size) AS size FROM occ GROUP BY sha256)
SELECT *, total_bytes - unique_bytes AS saved_bytes FROM (SELECT
 (SELECT count(*) FROM occ) AS occurrences, (SELECT count(*) FROM blobs) AS distinct_blobs,
 (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM blobs) AS unique_bytes,
 (SELECT CAST(coalesce(sum(b.size), 0) AS BIGINT) FROM occ a JOIN blobs b USING (sha256))
   AS total_bytes,
 (SELECT count(DISTINCT maildir_path) FROM occ) AS messages)""",
)
def facet_totals(spark, sf_dir):
    view = corpus.occurrences(spark, sf_dir)
    blobs = view.groupBy("sha256").agg(F.max("size").alias("size"))
    return b.facet_totals(view, blobs, view.select("maildir_path").distinct())
