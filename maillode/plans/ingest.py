"""Ingest: a directory of raw messages to the stored index.

1. list paths, read sizes and times, drop the files already stored;
2. parse what is left once, writing headers, part descriptions and body text,
   but no attachment bytes, to a staging table;
3. read again the messages chosen to supply the bytes of new digests, and write
   these; a digest whose message has moved or changed since is looked for in the
   other messages that hold it;
4. derive messages, attachments, bodies and blobs from the staging table. A digest
   becomes a blob only with its bytes stored. Messages with a digest that could not
   be read are listed as failures, and as they aren't stored, the next run tries
   them again.

Attachment bytes are never shuffled and never staged: step 3 spreads (message,
part) pairs and reads each file in the task that writes its content. Every step
reads files or written tables, so a lost executor costs its tasks and no more.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from email.policy import EmailPolicy

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts, incremental
from ..operators.dedup import blob_rows
from ..operators.mime import (
    addressed_parts,
    attachment_rows,
    body_rows,
    leaf_content,
    message_rows,
    modern_policy,
    occurrence_rows,
    parse_files,
    parse_messages,
    read_message,
    with_kinds,
)
from ..sources.maildir import read_file, scan_maildir, with_file_stats
from .store import Directory, IndexStore, bucket_of, open_index
from .views import rederive_direction

# Aims for tasks that fit an executor.
BYTES_PER_TASK = 128 << 20
FILES_PER_TASK = 20_000
CONTENT_PER_BATCH = 32 << 20


@dataclass(frozen=True)
class IngestOptions:
    me: Sequence[str] = ()
    min_size: int = 1
    limit: int | None = None
    reparse: bool = False


def ingest(
    spark: SparkSession, maildir: str, out: str, options: IngestOptions = IngestOptions()
) -> DataFrame:
    """Index a Maildir tree; returns the run's statistics as one row."""
    return ingest_files(scan_maildir(spark, maildir), out, options)


def ingest_files(
    files: DataFrame,
    out: str,
    options: IngestOptions = IngestOptions(),
    raws: DataFrame | None = None,
) -> DataFrame:
    """Index the files of (maildir_path, folder), and of scan_error where a scan gives it.

    Where mail is not on a path the executors can open, ``raws`` gives the bytes
    as (maildir_path, raw), and ``files`` brings mtime and size.
    """
    store = IndexStore(files.sparkSession, out)
    run = f"run-{uuid.uuid4().hex}"
    version, current = store.manifest()
    stage = f"{store.root}/staging/{run}"

    scanned = files.withColumn("read_error", F.lit(None).cast("string"))
    if raws is None:
        scanned = with_file_stats(files)
    scanned = _written(scanned, f"{stage}/scanned")
    known = store.read_from(current, "messages")
    todo = scanned.filter(F.col("read_error").isNull()).drop("read_error")
    if not options.reparse:
        todo = incremental.skip_known(todo, known)
    failed = store.read_from(current, "failures")
    todo, parsed = _read_mail(todo, failed, options.limit, raws, stage)
    attachments = attachment_rows(parsed, options.min_size)
    fresh = incremental.unseen(blob_rows(attachments), store.read_from(current, "blobs"))
    fresh = _written(fresh, f"{stage}/blobs")
    contents, lost = _store_contents(store, run, fresh, attachments, raws)
    if lost is not None:
        incomplete = lost.select("maildir_path").distinct()
        whole = parsed.join(incomplete, "maildir_path", "left_anti")
        fresh = fresh.join(lost.select("sha256").distinct(), "sha256", "left_anti")
    else:
        whole = parsed
    kept = attachment_rows(whole, options.min_size)

    following = {name: list(found) for name, found in current.items()}
    following.setdefault("blob_content", []).extend(contents)
    statistics = incremental.run_statistics(scanned, todo, parsed, kept, fresh, lost)
    failures = incremental.failure_rows(scanned, parsed, lost)
    tables = {
        "runs": statistics.withColumn("run", F.lit(run)),
        "failures": failures.withColumn("run", F.lit(run)),
    }
    if not todo.isEmpty():
        occurrences = occurrence_rows(whole, options.me, options.min_size)
        messages = {
            "messages": message_rows(whole, options.me),
            "attachments": kept,
            "bodies": body_rows(whole),
            "occurrences": browsable(occurrences),
        }
        came = messages | {"occurrences": occurrences, "blobs": fresh}
        went: dict[str, DataFrame] = {}
        if known.join(messages["messages"], "maildir_path", "left_semi").isEmpty():
            tables |= messages
        else:
            whole_buckets, went = _replacing(store, following, known, messages)
            tables |= whole_buckets
        tables["blobs"] = fresh
        tables |= _differences(store, current, came, went)
    for name, directory in _write_all(store, run, tables).items():
        following.setdefault(name, []).append(directory)
    store.commit(following, version + 1)
    return store.read("runs").filter(F.col("run") == run)


def _read_mail(
    files: DataFrame, failed: DataFrame, limit: int | None, raws: DataFrame | None, stage: str
) -> tuple[DataFrame, DataFrame]:
    """The files of a run and what was parsed from them.

    ``limit`` counts messages that could be indexed: for those that could not, further files
    are read, until there are enough or no more.
    """
    spark, number, left = files.sparkSession, 0, limit
    while True:
        chosen = _written(incremental.first_files(files, left, failed), f"{stage}/todo/part={number}")
        parsed = _written(_parsed(chosen, raws), f"{stage}/parsed/part={number}")
        if not limit:
            return chosen, parsed
        left -= parsed.filter(incremental.indexable()).count()
        number += 1
        if left <= 0 or chosen.isEmpty():
            break
        files = files.join(chosen.select("maildir_path"), "maildir_path", "left_anti")
    whole = [
        spark.read.schema(frame.schema).option("recursiveFileLookup", "true").parquet(path)
        for frame, path in ((chosen, f"{stage}/todo"), (parsed, f"{stage}/parsed"))
    ]
    return whole[0], whole[1]


#: Each round of looking for lost digests tries so many times the occurrences of the one before.
MORE_TRIES = 8
HOLDER = ["sha256", "maildir_path", "part_path"]


def next_holders(holders: DataFrame, tried: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` occurrences of each digest that were not tried yet, or all that are left.

    (sha256, maildir_path, part_path, size). The occurrences of a digest are dealt to ``most``
    slots, and of each slot the least one is taken: minima are merged before they are shuffled,
    so that a file which a third of all messages hold is no larger than any other.
    """
    slot = F.pmod(F.xxhash64("maildir_path", "part_path"), F.lit(most)).alias("slot")
    least = F.min(F.struct("maildir_path", "part_path", "size")).alias("least")
    left = holders.select(*HOLDER, "size").join(tried.select(*HOLDER), HOLDER, "left_anti")
    return left.groupBy("sha256", slot).agg(least).select("sha256", "least.*")


def _store_contents(
    store: IndexStore,
    run: str,
    fresh: DataFrame,
    attachments: DataFrame,
    raws: DataFrame | None,
) -> tuple[list[Directory], DataFrame | None]:
    """Write the bytes of new digests; returns the directories, and what was lost.

    Lost are the occurrences (sha256, maildir_path, part_path, problem) of digests of
    which none could be read. Every round tries further occurrences of what is missing,
    several times as many as the one before, so that rounds stay few.
    """
    spark, staging = store.spark, f"{store.root}/staging/{run}"
    directories, wanted, missing, number, most = [], fresh, fresh, 0, 1
    tried_paths = [f"{staging}/wanted/round=0"]
    wanted = _written(wanted.select(*HOLDER, "size"), tried_paths[0])
    while True:
        number += 1
        read = blob_contents(wanted, raws).filter(F.col("content").isNotNull())
        if number > 1:  # several occurrences of a digest may have been found
            read = read.dropDuplicates(["sha256"])
        directory = store.write(read, "blob_content", f"{run}-{number}")
        written = store.read_from({"blob_content": [directory]}, "blob_content")
        directories.append(directory)
        missing = missing.join(written.select("sha256"), "sha256", "left_anti")
        missing = _written(missing, f"{staging}/missing-{number}")
        if missing.isEmpty():
            return directories, None
        most *= MORE_TRIES
        holders = attachments.join(missing.select("sha256"), "sha256", "left_semi")
        tried = spark.read.schema(wanted.schema).parquet(*tried_paths)
        tried_paths.append(f"{staging}/wanted/round={number}")
        wanted = _written(next_holders(holders, tried, most), tried_paths[-1])
        if wanted.isEmpty():
            break
    problem = F.lit("the bytes of this part could not be read again").alias("problem")
    lost = holders.select(*HOLDER, problem)
    return directories, _written(lost, f"{staging}/lost")


def _replacing(
    store: IndexStore,
    following: dict[str, list[Directory]],
    known: DataFrame,
    tables: dict[str, DataFrame],
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Tables in which messages read again take the place of their old rows, and these.

    Only the buckets that hold such messages are written anew, together with what is new;
    ``following`` is told to pass over them in the older directories.
    """
    again = tables["messages"].select("maildir_path")
    changed = known.select("maildir_path").join(again, "maildir_path", "left_semi")
    # One row for each bucket at most.
    buckets = sorted(row[0] for row in changed.select(bucket_of()).distinct().collect())
    whole, went = {}, {}
    for name, frame in tables.items():
        old = store.rows_of_buckets(following, name, buckets)
        went[name] = old.join(again, "maildir_path", "left_semi")
        whole[name] = incremental.replace_children(old, frame.select(*old.columns), again)
        following[name] = [
            Directory(d.path, tuple(sorted({*d.without, *buckets})))
            for d in following.get(name, [])
        ]
    return whole, went


def _differences(
    store: IndexStore,
    current: dict[str, list[Directory]],
    came: dict[str, DataFrame],
    went: dict[str, DataFrame],
) -> dict[str, DataFrame]:
    """What a run changes of the counts, by the rows that came and went.

    An index that was begun without counts gets those of all that it holds, once.
    """
    if not current.get("facet_counts"):
        came = {
            name: store.read_from(current, name).select(*wanted).unionByName(frame.select(*wanted))
            for name, frame in came.items()
            if (wanted := COUNTED.get(name))
        }
    none = {name: frame.filter(F.lit(False)) for name, frame in came.items()}
    old = went or none
    digests = counts.digest_differences(came["occurrences"], old["occurrences"])
    return {
        # In order, so that the files of a page's digests can be told from others.
        "digest_counts": digests.repartitionByRange("sha256").sortWithinPartitions("sha256"),
        "facet_counts": counts.facet_differences(
            came["occurrences"], old["occurrences"], came["messages"], old["messages"], came["blobs"]
        ),
    }


#: What the counts need of each table.
COUNTED = {
    "occurrences": ["sha256", "size", "year", "folder"],
    "messages": ["maildir_path"],
    "blobs": ["size"],
}


def _write_all(
    store: IndexStore, run: str, tables: dict[str, DataFrame]
) -> dict[str, Directory]:
    """Write tables side by side: each is a job of its own over the same stage."""
    write = inheritable_thread_target(store.spark)(store.write)
    with ThreadPoolExecutor(len(tables)) as pool:
        writes = {name: pool.submit(write, frame, name, run) for name, frame in tables.items()}
        return {name: done.result() for name, done in writes.items()}


def _parsed(todo: DataFrame, raws: DataFrame | None) -> DataFrame:
    """Messages opened, with the type of each part in place of its leading bytes."""
    if raws is not None:
        found = todo.join(raws.select("maildir_path", "raw"), "maildir_path", "left")
        return with_kinds(parse_messages(found, bodies=True))
    total, count = todo.agg(F.sum("size"), F.count("*")).first()
    spread = todo.repartition(_tasks(total or 0, count), "maildir_path")
    return with_kinds(parse_files(spread, bodies=True))


def browsable(occurrences: DataFrame) -> DataFrame:
    """Rows in an order that lets filters on folder and year pass over row groups."""
    return occurrences.repartitionByRange("folder", "date_parsed").sortWithinPartitions(
        "folder", "date_parsed"
    )


def rederive(spark: SparkSession, out: str, me: Sequence[str]) -> None:
    """Decide every direction anew from stored columns, as a new version of the index."""
    store = open_index(spark, out)
    version, current = store.manifest()
    run = f"run-{uuid.uuid4().hex}"
    messages = rederive_direction(store.read_from(current, "messages"), me)
    following = current | {"messages": [store.write(messages, "messages", run)]}
    directions = store.read_from(following, "messages").select("maildir_path", "direction")
    occurrences = store.read_from(current, "occurrences").drop("direction")
    occurrences = browsable(occurrences.join(directions, "maildir_path"))
    following["occurrences"] = [store.write(occurrences, "occurrences", run)]
    store.commit(following, version + 1)


def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _tasks(total: int, count: int) -> int:
    return max(math.ceil(total / BYTES_PER_TASK), math.ceil(count / FILES_PER_TASK), 8)


def blob_contents(blobs: DataFrame, raws: DataFrame | None = None) -> DataFrame:
    """Bytes of each digest of (sha256, size, maildir_path, part_path).

    Rows of one message stand together, so it is opened once for all of them. A
    file that has changed since it was parsed leaves its digest without content
    and says so.
    """
    wanted = blobs.select("sha256", "maildir_path", "part_path")
    if raws is not None:
        found = wanted.join(raws.select("maildir_path", "raw"), "maildir_path", "left")
        return found.mapInArrow(content_stage(lambda want: (want["raw"], None)), CONTENT)
    total, count = blobs.agg(F.sum("size"), F.count("*")).first()
    spread = wanted.repartition(_tasks(total or 0, count), "maildir_path")
    ordered = spread.sortWithinPartitions("maildir_path")
    return ordered.mapInArrow(content_stage(lambda want: read_file(want["maildir_path"])), CONTENT)


CONTENT = "sha_prefix string, sha256 string, content binary, content_error string"


def content_stage(load):
    """Arrow stage from (sha256, maildir_path, part_path) to the content of each."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        modern = modern_policy()
        opened, parts, problem = None, {}, None
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                want = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if want["maildir_path"] != opened:
                    opened = want["maildir_path"]
                    parts, problem = open_parts(*load(want), modern)
                content, error = checked_content(parts, problem, want)
                rows.append((want["sha256"][:2], want["sha256"], content, error))
                held += len(content or b"")
                if held >= CONTENT_PER_BATCH:
                    yield _content_batch(rows)
                    rows, held = [], 0
            yield _content_batch(rows)

    return stage


def _content_batch(rows: list[tuple]) -> pa.RecordBatch:
    prefixes, digests, contents, errors = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(prefixes, pa.string()),
            pa.array(digests, pa.string()),
            pa.array(contents, pa.binary()),
            pa.array(errors, pa.string()),
        ],
        ["sha_prefix", "sha256", "content", "content_error"],
    )


def open_parts(raw: bytes | None, problem: str | None, modern: EmailPolicy):
    """Parts of a message by address, or why there are none."""
    if raw is None:
        return {}, problem or "no bytes"
    message, problem = read_message(raw, modern)
    if message is None:
        return {}, problem
    try:
        return dict(addressed_parts(message)), None
    except Exception as exc:
        return {}, repr(exc)


def checked_content(
    parts: dict, problem: str | None, want: dict
) -> tuple[bytes | None, str | None]:
    """Content of a wanted part if its digest is still the one asked for."""
    part = parts.get(want["part_path"])
    content = leaf_content(part)[0] if part is not None else None
    if content is None or hashlib.sha256(content).hexdigest() != want["sha256"]:
        return None, problem or "message changed since it was indexed"
    return content, None
