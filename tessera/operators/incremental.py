"""Incremental ingest: what needs work, what has gone, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import positions, running


def work_plan(disk: DataFrame, stored: DataFrame, key: str = "filename", modified: str = "mtime", ocr: bool = True, thumbnails: bool = True) -> DataFrame:
    """What each file on disk needs; files that need nothing are left out.

    ``stored`` has ``embedding_time``, ``ocr_time``, ``thumbnail_time`` and ``metadata``; a missing time is long ago.
    """
    j = disk.select(key, modified).join(stored.select(key, "embedding_time", "ocr_time", "thumbnail_time", "metadata"), key, "left")
    newer = lambda c: F.col(c).isNull() | (F.col(modified) > F.col(c))
    needs = {
        "needs_embed": newer("embedding_time"),
        "needs_ocr": newer("ocr_time") if ocr else F.lit(False),
        "needs_thumbnail": newer("thumbnail_time") if thumbnails else F.lit(False),
        "needs_metadata": newer("embedding_time") | F.col("metadata").isNull(),
    }
    out = j.select(key, modified, *[c.alias(n) for n, c in needs.items()])
    return out.filter("needs_embed OR needs_ocr OR needs_thumbnail OR needs_metadata")


def changed(disk: DataFrame, stored: DataFrame, key: str = "filename", modified: str = "mtime", formats: str | None = None, wanted: list[str] | None = None) -> DataFrame:
    """Files that are new or whose time differs from the stored one.

    With ``formats``, a column of ``stored``, also those whose stored formats are not the ``wanted`` ones, with
    ``missing``: the wanted formats that the file lacks.
    """
    old = stored.select(F.col(key).alias("_key"), F.col(modified).alias("_old"), *([F.col(formats).alias("_formats")] if formats else []))
    j = disk.join(old, disk[key] == F.col("_key"), "left")
    moved = ~F.col("_old").eqNullSafe(F.col(modified))
    if not formats:
        return j.filter(moved).drop("_key", "_old")
    want = F.array(*[F.lit(w) for w in wanted or []]).cast("array<string>")
    have = F.coalesce("_formats", F.array().cast("array<string>"))
    other = F.array_sort(F.array_distinct(have)) != F.array_sort(F.array_distinct(want))
    return j.filter(moved | other).withColumn("missing", F.array_except(want, have)).drop("_key", "_old", "_formats")


def stale_scans(files: DataFrame, scans: DataFrame, key: str = "filename") -> DataFrame:
    """Files never scanned, or scanned before they changed."""
    return files.join(scans.select(key, "scan_time"), key, "left").filter("scan_time IS NULL OR scan_time < modtime")


def vanished(stored: DataFrame, disk: DataFrame, key: str = "filename") -> DataFrame:
    """Stored rows whose file has gone."""
    return stored.join(disk.select(key), key, "left_anti")


def stale_frames(files: DataFrame) -> DataFrame:
    """Frames beyond the end of their video: rows with ``frame >= frames``."""
    return files.filter(F.col("frame").isNotNull() & (F.col("frame") >= F.col("frames")))


def upsert(stored: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Replace whole rows by key: the last change by ``order``, else a stored row.

    A null key is a key like others.  Without an order, the change of a key that is last as JSON counts.
    """
    changes = last_by(changes, [key], order)
    known = changes.select(F.col(key).alias("_known"))
    return stored.join(known, stored[key].eqNullSafe(F.col("_known")), "left_anti").select(*stored.columns).unionByName(changes.select(*stored.columns))


def merge(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Insert missing keys and overwrite only the columns that a change has a value for.

    A null key is a key like others.  Of several changes of a key, each column takes the greatest value.
    """
    others = [x for x in changes.columns if x != key]
    c = changes.groupBy(F.col(key).alias(f"_{key}")).agg(F.lit(True).alias("_there"), *[F.max(x).alias(f"_{x}") for x in others])
    j = stored.join(c, stored[key].eqNullSafe(F.col(f"_{key}")), "full")
    return j.select(*[F.coalesce(f"_{x}", x).alias(x) if x in changes.columns else F.col(x) for x in stored.columns])


def last_by(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """The last row of each key; among equals the one that is last as JSON, so that every run takes the same."""
    by = [] if order is None else [F.col(order).desc()]
    w = Window.partitionBy(*keys).orderBy(*by, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).desc())
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def resume_point(written: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """The newest time and the number of rows of what has been written."""
    return written.agg(F.max(timestamp).alias("latest"), F.count(F.lit(1)).alias("rows"))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Add ``unique_name``: the first row of a name keeps it, the others get ``name-2``, ``name-3`` … in order.

    A suffix whose name some row already has is passed over, so that no two rows share a name.  Rows and taken suffixes of a name stand in one
    order, by how many free suffixes precede them, so a row's number follows from a running count; no row carries a list of suffixes.
    """
    ending = F.regexp_extract(name, "-([2-9]|[1-9][0-9]{1,8})$", 1)
    names = df.select(F.col(name)).distinct().withColumn("_suffix", ending).filter("_suffix != ''")
    base = F.expr(f"substring({name}, 1, length({name}) - length(_suffix) - 1)")
    taken = positions(names.select(base.alias("_base"), F.col("_suffix").cast("long").alias("_suffix")), [F.col("_suffix")], ["_base"])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = positions(df, [F.col(order)], [name]).select(F.col(name).alias("_base"), F.col("place").alias("_v"), F.lit(0).alias("_kind"), row.alias("_row"))
    gaps = taken.select("_base", (F.col("_suffix") - 2 - F.col("place")).alias("_v"), F.lit(1).alias("_kind"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    placed = running(rows.unionByName(gaps), {"_before": F.col("_kind")}, [F.col("_v"), F.col("_kind")], ["_base"]).filter("_kind = 0")
    suffix = F.concat_ws("-", "_base", F.col("_v") + 1 + F.col("_before"))
    return placed.select("_row.*", F.when(F.col("_v") == 0, F.col("_base")).otherwise(suffix).alias("unique_name"))
