"""Execution timelines from program-cache entries: anchors, ranges, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracequarry.functions import forensic as fx
from tracequarry.runtime import many_columns


def anchor(entries: DataFrame, patterns: Sequence[str], path: str = "path", modified: str = "last_modified") -> DataFrame:
    """Adds exact_ts and how: a path that matches a pattern (any letter case) ran at its modification time."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.lower(F.col(path)).rlike("(?i)" + p)
    hit = F.coalesce(hit, F.lit(False)) & F.col(modified).isNotNull()
    return entries.withColumn("exact_ts", F.when(hit, F.col(modified))).withColumn("how", F.when(hit, F.lit("PatternMatch")))


def fill_ranges(entries: DataFrame, source: str, position: str) -> DataFrame:
    """Adds range_from, range_to and ts_kind to rows that are ordered from newest to oldest.

    Between two exact rows an entry ran after the later row's time and before the earlier's
    (Range); before the first exact row only its lower end is known (RangeStart), after the
    last only its upper end (RangeEnd). One window pass per source."""
    w = W.partitionBy(source).orderBy(position)
    newer = F.last("exact_ts", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    older = F.first("exact_ts", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    out = entries.withColumn("__newer", newer).withColumn("__older", older)
    exact = F.col("exact_ts").isNotNull()
    kind = (
        F.when(exact, "Exact")
        .when(F.col("__newer").isNotNull() & F.col("__older").isNotNull(), "Range")
        .when(F.col("__older").isNotNull(), "RangeStart")
        .when(F.col("__newer").isNotNull(), "RangeEnd")
    )
    return (
        out.withColumn("range_from", F.when(~exact, F.col("__older")))
        .withColumn("range_to", F.when(~exact, F.col("__newer")))
        .withColumn("ts_kind", kind)
        .withColumn("display_ts", F.coalesce("exact_ts", "range_from", "range_to"))
        .drop("__newer", "__older")
    )


def attach_files(entries: DataFrame, files: DataFrame, path: str = "path", file_path: str = "file_path", order: Sequence[str] = ()) -> DataFrame:
    """Left lookup of inventory files by path in any letter case; of several the last by ``order`` counts."""
    values = [c for c in files.columns if c != file_path]
    ranked = files.where(F.col(file_path).isNotNull()).groupBy(F.lower(file_path).alias("__key")).agg(
        F.max_by(F.struct(*values), F.struct(*[F.col(c) for c in (order or values)])).alias("__file")
    )
    joined = entries.withColumn("__key", F.lower(path)).join(ranked, "__key", "left")
    return joined.select(*[F.col(f"`{c}`") for c in entries.columns], *[F.col(f"__file.{c}").alias(f"file_{c}" if c in entries.columns else c) for c in values])


def attach_programs(entries: DataFrame, programs: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Left lookup of inventory programs by name and version; of several the last by ``order`` counts.

    Adds ``program_id`` and ``program_ts``; rows that are files have no name and find none."""
    values = [c for c in programs.columns if c not in ("program_name", "version")]
    ranked = programs.where(F.col("program_name").isNotNull()).groupBy(F.col("program_name").alias("__p"), F.col("version").alias("__v")).agg(
        F.max_by(F.struct(*values), F.struct(*[F.col(c) for c in (order or values)])).alias("__program")
    )
    joined = entries.join(ranked, (F.col("program_name") == F.col("__p")) & (F.col("program_version") == F.col("__v")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in entries.columns], *[F.col(f"__program.{c}").alias(f"inventory_{c}" if c in entries.columns else c) for c in values])


def near(a: Column, b: Column, seconds: int = 60) -> Column:
    """Whether two times are at most so far apart."""
    return F.abs(F.unix_millis(a) - F.unix_millis(b)) <= seconds * 1000


def near_pairs(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int = 60) -> DataFrame:
    """All pairs of rows of one key whose times are at most so far apart; the frames share no other column.

    An equality join on key and time slice: right rows are put into their own slice and the
    two beside it, so that a busy key is parted by time and only neighbours are compared."""
    span = seconds * 1000
    slice_of = lambda c: F.floor(F.unix_millis(F.col(c)) / span)
    a = left.withColumn("__slice", slice_of(left_ts))
    b = right.withColumn("__slice", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: slice_of(right_ts) + d)))
    return a.join(b, [key, "__slice"]).where(near(F.col(left_ts), F.col(right_ts), seconds)).drop("__slice")


def with_anchor(entries: DataFrame, updates: DataFrame, source: str = "source", position: str = "position") -> DataFrame:
    """Entries with a row before each source's first one that ran when its cache was last written.

    ``updates``: source and last_update_ts. ``entries`` must have exact_ts and how."""
    first = updates.where(F.col("last_update_ts").isNotNull()).groupBy(source).agg(F.max("last_update_ts").alias("exact_ts"))
    rows = first.select(source, F.lit(-1).cast(entries.schema[position].dataType).alias(position), "exact_ts", F.lit("ShimcacheLastUpdate").alias("how"))
    return entries.unionByName(rows, allowMissingColumns=True)


_RANGES = ("range_from", "range_to", "ts_kind", "display_ts")


@many_columns()
def timeline(
    entries: DataFrame, patterns: Sequence[str] = (), files: DataFrame | None = None, near_pairs: bool = False,
    source: str = "source", position: str = "position", path: str = "path", modified: str = "last_modified", file_ts: str = "file_ts",
    programs: DataFrame | None = None, updates: DataFrame | None = None, file_order: Sequence[str] = (),
) -> DataFrame:
    """Entries with exact times or ranges, in order of position within each source.

    1. Pattern anchors, and with ``updates`` (see :func:`with_anchor`) the row for the last
    write; 2. ranges; 3. inventory files by path (and programs by name and version); with
    ``near_pairs``, entries whose modification time is within a minute of their file's take
    that time, unless a pattern anchors them; 4. a file's time inside an entry's range makes
    it exact; 5. final ranges and entry numbers. Entries without a path (programs) are never
    anchored. The windows part by source, one cache of about a thousand entries.
    """
    out = anchor(entries, patterns, path, modified)
    if updates is not None:
        out = with_anchor(out, updates, source, position)
    out = fill_ranges(out, source, position)
    if programs is not None:
        out = attach_programs(out, programs)
    if files is not None:
        out = attach_files(out, files, path, order=file_order)
        if near_pairs:
            pair = F.coalesce((F.col("exact_ts").isNull() | ~F.coalesce(F.col("how").isin("PatternMatch", "ShimcacheLastUpdate"), F.lit(False))) & near(F.col(modified), F.col(file_ts)), F.lit(False))
            out = out.withColumn("__pair", pair).withColumn("how", F.when(F.col("__pair"), F.lit("NearTSMatch")).otherwise(F.col("how")))
            out = out.withColumn("exact_ts", F.when(F.col("__pair"), F.col(file_ts)).otherwise(F.col("exact_ts"))).drop("__pair")
            out = fill_ranges(out.drop(*_RANGES), source, position)
        inside = F.coalesce((F.col("ts_kind") == "Range") & (F.col(file_ts) > F.col("range_from")) & (F.col(file_ts) < F.col("range_to")), F.lit(False))
        out = out.withColumn("__in", inside).withColumn("how", F.when(F.col("__in"), F.lit("AmcacheRangeMatch")).otherwise(F.col("how")))
        out = out.withColumn("exact_ts", F.when(F.col("__in"), F.col(file_ts)).otherwise(F.col("exact_ts"))).drop("__in")
        out = fill_ranges(out.drop(*_RANGES), source, position)
    return out.withColumn("entry_number", F.row_number().over(W.partitionBy(source).orderBy(position)))


def timeline_columns(rows: DataFrame, path: str = "path", sha1: str = "sha1") -> DataFrame:
    """A timeline as its eight columns of text: Timestamp, File Path, Program Name, SHA-1 Hash,
    Timeline Entry Number, Entry Type, Timestamp Description, Raw Entry."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    program = has("program_entry")
    kind = F.when(F.col("how") == "ShimcacheLastUpdate", "ShimcacheLastUpdate").when(program.isNotNull(), "Program").otherwise("File")
    return rows.select(
        fx.rfc3339(F.col("display_ts")).alias("Timestamp"), has(path).alias("File Path"), has("program_name").alias("Program Name"), has(sha1).alias("SHA-1 Hash"),
        F.col("entry_number").alias("Timeline Entry Number"), kind.alias("Entry Type"),
        F.when(F.col("ts_kind") == "Exact", F.col("how")).otherwise(F.col("ts_kind")).alias("Timestamp Description"), program.alias("Raw Entry"),
    )
