"""Files tables: reading, scope, routing, failures and coverage.

A files table has path, length and content (binary or text), and may have ``is_link``. Scope and
routing use the path only, so Spark never reads the content of a pruned file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import paths
from proofline.functions.lookup import text_array
from proofline.session import written


LISTED = "path string, relative string, length long, is_link boolean, is_folder boolean"
#: Bytes of file content in one Arrow batch that a task hands back.
BATCH_BYTES = 16 << 20


def list_tree(spark: SparkSession, root: str, profile: str = "source", max_files: int | None = None) -> DataFrame:
    """(path, relative, length, is_link) of every file below ``root``, never entering an excluded or linked directory.

    Spark's own file readers skip names that start with ``_`` or ``.``, so the tree is listed here, one level of folders
    per pass, each folder a row that some task lists. Only names below the root can exclude a folder. ``max_files`` stops
    larger trees, if given.
    """
    excluded, remote = frozenset(excluded_dirs(profile)), "://" in root
    base = fs.FileSystem.from_uri(root)[1] if remote else os.path.abspath(root)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = fs.FileSystem.from_uri(root)[0] if remote else fs.LocalFileSystem()
        for batch in batches:
            for folder, inside in zip(batch["path"], batch["relative"]):
                rows = []
                for entry in system.get_file_info(fs.FileSelector(folder)):
                    link = not remote and os.path.islink(entry.path)
                    relative = f"{inside}/{entry.base_name}" if inside else entry.base_name
                    is_folder = entry.type == fs.FileType.Directory
                    if not is_folder or entry.base_name not in excluded and not link:
                        rows.append((entry.path, relative, entry.size or 0, link, is_folder))
                yield pd.DataFrame(rows, columns=["path", "relative", "length", "is_link", "is_folder"])

    folders = spark.createDataFrame([(base, "")], "path string, relative string")
    found: DataFrame | None = None
    while True:
        level = written(folders.repartition(spark.sparkContext.defaultParallelism).mapInPandas(entries, LISTED), "tree")
        own = level.where("not is_folder").drop("is_folder")
        found = own if found is None else found.unionByName(own)
        folders = level.where("is_folder").select("path", "relative")
        if folders.isEmpty():
            break
    return found if max_files is None else require_at_most(found, max_files, "file count")


def read_tree(spark: SparkSession, root: str, profile: str = "source", max_files: int | None = None,
              max_bytes: int | None = None) -> DataFrame:
    """Files table of a tree. Executors open only files that are in scope, not linked and, if a limit is given, not oversized."""
    spread = list_tree(spark, root, profile, max_files).repartition(spark.sparkContext.defaultParallelism)
    small = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    wanted = spread.withColumn("_read", (F.size(handlers("path")) > 0) & ~F.col("is_link") & small)
    remote = "://" in root

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = fs.FileSystem.from_uri(root)[0] if remote else fs.LocalFileSystem()
        columns, rows, size = ["path", "relative", "length", "is_link", "content"], [], 0
        for batch in batches:
            for path, relative, length, link, read in batch.itertuples(index=False):
                text = None
                if read:
                    try:
                        with system.open_input_stream(path) as stream:
                            text = stream.read().decode("utf-8", errors="replace")
                    except OSError:
                        pass  # stays null: an unreadable file
                rows.append((path, relative, length, link, text))
                size += len(text or "")
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return wanted.mapInPandas(load, "path string, relative string, length long, is_link boolean, content string")


def excluded_dirs(profile: str = "source") -> tuple[str, ...]:
    if profile not in C.BLIND_SPOT_PROFILE:
        raise ValueError(f"unknown scan profile: {profile}")
    return C.EXCLUDED_DIRS + (C.VENV_DIRS if profile == "source" else ())


def in_tree(path: Column | str, profile: str = "source") -> Column:
    """Whether no directory on the path is excluded; the file's own name does not count."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), text_array(excluded_dirs(profile)))


def handlers(path: Column | str, filenames: Sequence[tuple] = C.FILENAME_ROUTES, extensions: Sequence[tuple] = C.EXTENSION_ROUTES) -> Column:
    """Collectors and parsers for a path: exact name first, then extension, each collector once."""
    def table(routes: Sequence[tuple]) -> Column:
        grouped: dict[str, list] = {}
        for match, collector, parser in routes:
            grouped.setdefault(match, []).append(F.struct(F.lit(collector).alias("collector"), F.lit(parser).alias("parser")))
        cells: list[Column] = []
        for match, routed in grouped.items():
            cells += [F.lit(match), F.array(*routed)]
        return F.create_map(*cells)

    none = F.array().cast("array<struct<collector:string,parser:string>>")
    by_name = F.coalesce(F.try_element_at(table(filenames), paths.file_name(path)), none)
    by_extension = F.coalesce(F.try_element_at(table(extensions), paths.extension(path)), none)
    routed = F.concat(by_name, by_extension)
    names = F.transform(routed, lambda h: h["collector"])
    return F.filter(routed, lambda h, i: F.array_position(names, h["collector"]) == i + 1)


def inventory(files: DataFrame, profile: str = "source") -> DataFrame:
    """Files left after pruning, with their handlers and whether they are in scope.

    Only names below the scan root prune: a table with full paths says where files lie below it in ``relative``.
    """
    kept = files.where(in_tree("relative" if "relative" in files.columns else "path", profile)).withColumn("handlers", handlers("path"))
    return kept.withColumn("in_scope", F.size("handlers") > 0)


def routes(files: DataFrame, profile: str = "source") -> DataFrame:
    rows = inventory(files, profile).where("in_scope")
    return rows.select("path", F.explode("handlers").alias("h")).select("path", "h.collector", "h.parser")


def with_failure(scoped: DataFrame, max_bytes: int | None = C.MAX_FILE_BYTES) -> DataFrame:
    """Adds ``failure`` for in-scope files that cannot be read: linked, oversized (if there is a limit) or unreadable."""
    linked = F.coalesce(F.col("is_link"), F.lit(False)) if "is_link" in scoped.columns else F.lit(False)
    code = F.when(linked, "linked_file").when(F.lit(False) if max_bytes is None else F.col("length") > max_bytes, "oversized").when(F.col("content").isNull(), "unreadable")
    return scoped.withColumn("failure", F.when(F.col("in_scope"), code))


def read_failures(scoped: DataFrame) -> DataFrame:
    return scoped.where("failure is not null").select("path", F.col("failure").alias("reason"))


def failures(*parts: DataFrame, root: str = "") -> DataFrame:
    """One reason per failed path with its API-safe relative path, by path.

    Earlier parts win: pass read failures before parser failures.
    """
    merged = None
    for turn, part in enumerate(parts):
        rows = part.select("path", F.coalesce("reason", F.lit("parse_error")).alias("reason"), F.lit(turn).alias("_turn"))
        merged = rows if merged is None else merged.unionByName(rows)
    first = merged.groupBy("path").agg(F.min_by("reason", F.struct("_turn", "reason")).alias("reason"))
    shown = paths.relative_path("path", F.lit(root)) if root else paths.relative_path(F.concat(F.lit("/"), "path"), F.lit("/"))
    return first.select(shown.alias("path"), "reason").where("path is not null").orderBy("path")


def coverage(scoped: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Total, in-scope, scanned and failed files and the coverage percentage, in one row."""
    if failed is not None:
        marks = failed.select("path", F.lit(True).alias("_failed")).distinct()
        scoped = scoped.join(marks, "path", "left")
        bad = F.col("in_scope") & (F.col("failure").isNotNull() | F.coalesce("_failed", F.lit(False)))
    else:
        bad = F.col("failure").isNotNull()
    counts = scoped.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("in_scope").alias("in_scope_files"), F.count_if(bad).alias("failed_files")
    ).withColumn("scanned_files", F.col("in_scope_files") - F.col("failed_files"))
    percent = F.round(100.0 * F.col("scanned_files") / F.nullif(F.col("in_scope_files"), F.lit(0)), 2)
    return counts.withColumn("coverage_pct", F.coalesce(percent, F.lit(0.0)))


def collector_stats(evidence: DataFrame, collectors: Sequence[str] = C.COLLECTORS) -> DataFrame:
    """Evidence per collector in one row, zero-filled."""
    return evidence.agg(*[F.count_if(F.col("source") == c).alias(c) for c in collectors])


def blind_spots(metrics: DataFrame, profile: str = "source", duration_ms: int = 0, memory_mb: int = 0) -> DataFrame:
    """The fixed statements and the ones the metrics call for, as one array."""
    fixed = [*C.BLIND_SPOTS_ALWAYS, C.BLIND_SPOT_PROFILE[profile], *C.BLIND_SPOTS_CLOSING]
    conditional = [
        F.when(F.col("in_scope_files") == 0, C.BLIND_SPOT_NO_FILES),
        F.when(F.col("failed_files") > 0, F.format_string(C.BLIND_SPOT_FAILURES, "failed_files")),
        F.lit(C.BLIND_SPOT_DURATION % (duration_ms / 1000) if duration_ms > 0 else None),
        F.lit(C.BLIND_SPOT_MEMORY % memory_mb if memory_mb > 0 else None),
    ]
    return metrics.withColumn("blind_spots", F.array_compact(F.array(*[F.lit(s) for s in fixed], *conditional)))


def require_at_most(frame: DataFrame, limit: int, what: str) -> DataFrame:
    """The frame itself; stops when it has more rows than allowed.

    The probe reads at most ``limit + 1`` rows per partition and returns one flag to the driver.
    """
    if frame.limit(limit + 1).count() > limit:
        raise ValueError(f"{what} exceeds the configured limit of {limit}")
    return frame


def limit_guard(counts: DataFrame, limit: int, what: str, count: str = "count") -> DataFrame:
    """The lazy form for a one-row count: running it fails when the limit is passed."""
    message = F.lit(f"{what} exceeds the configured limit of {limit}")
    return counts.withColumn(count, F.when(F.col(count) <= limit, F.col(count)).otherwise(F.raise_error(message).cast("long")))


def verify_checksums(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (path, sha256) with ``status``: ok, mismatch or missing."""
    actual = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("_actual"))
    status = F.when(F.col("_actual").isNull(), "missing").when(F.col("_actual") == F.lower("sha256"), "ok").otherwise("mismatch")
    return manifest.join(actual, "path", "left").withColumn("status", status).drop("_actual")
