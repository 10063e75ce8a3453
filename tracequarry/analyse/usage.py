"""Resource-usage records: id lookups, table names, time frames and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions import forensic as fx

#: Columns that hold FILETIMEs.
FILETIMES = ("EndTime", "ConnectStartTime", "StartTime")
#: Fixed value: the type of ids that are users.
USER_ID = 3


def table_guid(table: Column) -> Column:
    """The upper-case GUID of a table, without the mark of its long-term twin."""
    return F.upper(F.regexp_replace(table, r"(?i)LT$", ""))


def is_long_term(table: Column) -> Column:
    return F.coalesce(table.rlike(r"(?i)LT$"), F.lit(False))


def id_map(records: DataFrame) -> DataFrame:
    """The id map among an ESE database's documents: id_index, id_type, id_blob (hex), id_text, id_sid, row_id.

    The text leaves NULs out; ids of users have a security identifier instead."""
    data = F.col("data")
    rows = records.where((F.col("kind") == "esedb") & (F.get_json_object(data, "$.Table") == "SruDbIdMapTable"))
    field = lambda n: F.get_json_object(data, f"$.{n}")
    rows = rows.select("source", F.col("record_id").alias("row_id"), field("IdIndex").cast("bigint").alias("id_index"), field("IdType").cast("int").alias("id_type"), field("IdBlob").alias("id_blob"))
    user = F.col("id_type") == USER_ID
    blob = F.unhex("id_blob")
    plain = F.replace(F.decode(blob, "ISO-8859-1"), F.lit("\0"), F.lit(""))
    return rows.withColumn("id_text", F.when(~user, plain)).withColumn("id_sid", F.when(user, fx.sid_text(blob)))


def latest_ids(id_map: DataFrame, key: str = "id_index", order: str = "row_id") -> DataFrame:
    """One row per id: the last by ``order``; among rows of the same order the greatest values."""
    values = [c for c in id_map.columns if c != key]
    best = id_map.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*values), F.struct(order, *[v for v in values if v != order])).alias("__v"))
    return best.select(key, *[F.col(f"__v.{c}").alias(c) for c in values])


def enrich(facts: DataFrame, id_map: DataFrame | None = None, users: DataFrame | None = None, tables: DataFrame | None = None, order: str = "row_id") -> DataFrame:
    """Adds app_name, user_sid, user_name and table_name to usage records by left lookups.

    ``id_map`` (id_index, id_text and perhaps id_sid, and ``order``), ``users`` (sid, user) and
    ``tables`` (guid, table_name) are joined as the optimiser sees fit; of several rows of
    one id the last by ``order`` counts, of several users or tables the greatest name.
    Unknown ids give nulls and lose no record."""
    out = facts
    if id_map is not None:
        sid = "id_sid" if "id_sid" in id_map.columns else "id_text"
        ids = latest_ids(id_map.select("id_index", *dict.fromkeys(["id_text", sid, order])), "id_index", order)
        out = out.join(ids.select(F.col("id_index").alias("__a"), F.col("id_text").alias("app_name")), F.col("app_id") == F.col("__a"), "left").drop("__a")
        out = out.join(ids.select(F.col("id_index").alias("__u"), F.col(sid).alias("user_sid")), F.col("user_id") == F.col("__u"), "left").drop("__u")
        if users is not None:
            names = users.groupBy(F.col("sid").alias("__s")).agg(F.max("user").alias("user_name"))
            out = out.join(names, F.col("user_sid") == F.col("__s"), "left").drop("__s")
    if tables is not None:
        known = tables.where(F.col("guid").isNotNull()).groupBy(F.upper("guid").alias("__g")).agg(F.max("table_name").alias("__n"))
        out = out.join(known, table_guid(F.col("table")) == F.col("__g"), "left")
        out = out.withColumn("table_name", F.concat(F.col("__n"), F.when(is_long_term(F.col("table")), F.lit(" (Long Term)")).otherwise(F.lit("")))).drop("__g", "__n")
    return out


def usage_records(records: DataFrame, users: DataFrame | None = None, extensions: DataFrame | None = None) -> DataFrame:
    """The usage rows of ESE databases with names in place of ids: one row per record.

    source, record_id, table, timestamp, app_id, user_id, app_name, user_sid, user_name,
    table_name, the times of ``FILETIMES`` as ISO text, and the whole record as ``data``."""
    data = F.col("data")
    field = lambda n: F.get_json_object(data, f"$.{n}")
    facts = records.where((F.col("kind") == "esedb") & data.isNotNull() & field("AppId").isNotNull()).select(
        "source", "record_id", field("Table").alias("table"), field("TimeStamp").alias("timestamp"), field("AppId").cast("bigint").alias("app_id"), field("UserId").cast("bigint").alias("user_id"),
        *[fx.filetime_seconds(field(n).try_cast("bigint")).alias(n) for n in FILETIMES], "data",
    )
    return enrich(facts, id_map(records), users, extensions)


def time_frames(facts: DataFrame, table: str = "table", timestamp: str = "timestamp") -> DataFrame:
    """First and last time of each table, by its upper-case GUID."""
    return facts.groupBy(F.upper(table).alias("guid")).agg(F.min(timestamp).alias("first_seen"), F.max(timestamp).alias("last_seen"), F.count("*").alias("n_records"))


def retained_tables(extensions: DataFrame, parameters: DataFrame) -> DataFrame:
    """The tables that settings describe, long-term twins included: guid, table_name, dll_path, retention_time_days.

    A table's own setting comes before the common one, and that before the default."""
    common = parameters.select("source", *[F.col(c).alias(f"__{c}") for c in parameters.columns if c != "source"])
    both = extensions.join(common, "source", "left")
    pair = lambda tier: ((F.col(f"{tier}Period"), F.col(f"{tier}MaxEntries")), (F.col(f"__{tier}Period"), F.col(f"__{tier}MaxEntries")))
    plain = both.select("guid", "table_name", "dll_path", fx.retention_days(*pair("Tier2")).alias("retention_time_days"))
    long_term = both.where("long_term").select(
        F.concat("guid", F.lit("LT")).alias("guid"), F.concat("table_name", F.lit(" (Long Term)")).alias("table_name"), "dll_path", fx.retention_days(*pair("Tier2LongTerm"), "Tier2LongTerm").alias("retention_time_days")
    )
    return plain.unionByName(long_term)


def details(frames: DataFrame, tables: DataFrame) -> DataFrame:
    """Table details with name, DLL, time frame, retention in days and as text, for all known tables, by GUID.

    Of several rows of one table the greatest name and the longest retention count."""
    has_dll = "dll_path" in tables.columns
    known = tables.where(F.col("guid").isNotNull()).groupBy(F.upper("guid").alias("guid")).agg(
        F.max("table_name").alias("table_name"), F.max("retention_time_days").alias("retention_time_days"), *([F.max("dll_path").alias("dll_path")] if has_dll else [])
    )
    return known.join(frames, "guid", "left").withColumn("retention", fx.format_duration(F.col("retention_time_days"))).orderBy("guid")
