"""Queries over the forensic tables for the general data-preparation problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import hierarchy, instants, nested, skew, wide
from tracequarry.plans.instants_sql import found_instants
from tracequarry.plans.nested_sql import nested_rows
from tracequarry.plans.wide_sql import found_cells
from tracequarry.runtime import table

#: The wanted attributes of registry keys by kind.
REGISTRY_ATTRIBUTES = [
    wide.Attribute(name, kind)
    for kind, names in (
        ("int", "Size Language IsOsComponent Usn HiddenArp InboxModernApp EstimatedSize Start ServiceType ErrorControl DelayedAutostart"),
        ("datetime", "LinkDate InstallDate"),
        ("list", "DependOnService RequiredPrivileges"),
        ("bytes", "MsiUpgradeCode FailureActions"),
        ("text", "FileId LowerCaseLongPath ProgramId BinFileVersion BinaryType AppxPackageName Name Version Publisher RootDirPath DisplayName ImagePath ObjectName"),
    )
    for name in names.split()
]


def registry_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One typed row per registry key under the inventory and service branches."""
    rows = table(spark, folder, "reg_values")
    path = F.lower("key_path")
    under = (path.contains("inventoryapplication") | path.contains("services")) & path.rlike(r"(^|\\)(inventoryapplicationfile|inventoryapplication|services)(\\|$)")
    return wide.attributes_to_wide(rows.where(under), REGISTRY_ATTRIBUTES)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return wide.wide_cells(registry_wide(spark, folder), REGISTRY_ATTRIBUTES)


#: The columns with timestamps of each table.
TIMESTAMPS = {"hunt_docs": ("doc_timestamp",), "table_details": ("time_from",), "mft_entries": ("standard_info_created", "file_name_created_ft")}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, columns in TIMESTAMPS.items():  # one scan of each table
        t = table(spark, folder, name)
        values = []
        for column in columns:
            c = F.col(column)
            canonical = instants.is_canonical_number(c) | (c <= 0) if column.endswith("_ft") else instants.is_canonical_text(c)
            values.append(F.struct(F.lit(column).alias("fld"), F.when(~canonical, c.cast("string")).alias("text")))
        each = t.select(F.lit(name).alias("rec_table"), F.col("row_id").alias("rec_id"), "computer", F.explode(F.array(*values)).alias("__v"))
        parts.append(each.select("rec_table", "rec_id", "__v.fld", "computer", F.col("__v.text").alias("__text")).where(F.col("__text").isNotNull()))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    done = instants.normalise_instants(rows, table(spark, folder, "host_zones"), "__text")
    return done.where(F.col("utc").isNotNull()).select("rec_table", "rec_id", "fld", instants.utc_text(F.col("utc")).alias("utc"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = skew.rule_groups(table(spark, folder, "agg_hits"), table(spark, folder, "hunt_rules"))
    return groups.select("source_file", "rule_id", "key_text")


#: The arrays of objects in each table's records.
NESTED_ARRAYS = {
    "hunt_docs": ("doc_data", "", [
        "Event.EventData.Privileges", "Event.UserData.Changes", "Event.UserData.Changes.Actors", "values",
        "Report.Processes", "Report.Processes.Modules", "Report.Processes.Modules.Exports", "Report.Processes.Connections",
    ]),
    "srum_db": ("db_content", "root", ["root", "root.Intervals", "root.Intervals.Counters"]),
}


def nested_tables(spark: SparkSession, folder: str, name: str, with_columns: bool = True) -> tuple[DataFrame, nested.SchemaGraph]:
    """The shredded rows of one table's records and their schema graph."""
    column, root, arrays = NESTED_ARRAYS[name]
    records = table(spark, folder, name).select("row_id", column)
    graph = nested.analyse(records, column, root, arrays)
    return nested.shred(records, graph, "row_id", column, root, with_columns), graph


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, (_, _, arrays) in NESTED_ARRAYS.items():
        rows, _ = nested_tables(spark, folder, name, with_columns=False)
        parts.append(rows.where(F.col("arr_path").isin(*arrays)).select(F.lit(name).alias("rec_table"), "rec_id", "arr_path", "ordinals"))
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "mft_entries")
    out = hierarchy.hierarchy(rows, "volume_id", "entry_id", "base_entry_id", "file_name", ["collected_at", "row_id"])
    return out.select(
        "volume_id",
        "entry_id",
        F.col("root").alias("root_entry_id"),
        F.col("depth").cast("int").alias("node_depth"),
        F.col("n_desc").cast("int").alias("n_desc"),
        F.col("path").alias("node_path"),
    )


def p6_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry with each entry above it."""
    out = hierarchy.descendants(table(spark, folder, "mft_entries"), "volume_id", "entry_id", "base_entry_id", ["collected_at", "row_id"])
    return out.select("volume_id", "ancestor", "entry_id", "distance")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_descendants": p6_descendants}

ORACLE_SQL = {
    "p1_found": found_cells(REGISTRY_ATTRIBUTES),
    "p2_found": found_instants(TIMESTAMPS),
    "p5_found": nested_rows(),
    "p4_found": """
        WITH keyed AS (
          SELECT h.source_file, h.rule_id, h.doc_no, r.agg_count,
                 list_transform(r.agg_fields, lambda f: CASE f WHEN 'computer' THEN h.computer WHEN 'target_user' THEN h.target_user WHEN 'ip_address' THEN h.ip_address END) AS vals
          FROM agg_hits h JOIN hunt_rules r USING (rule_id)
          WHERE r.agg_count IS NOT NULL AND r.agg_fields IS NOT NULL),
        counted AS (
          SELECT source_file, rule_id, agg_count, array_to_string(vals, '|') AS key_text, count(DISTINCT doc_no) AS n
          FROM keyed WHERE len(list_filter(vals, lambda v: v IS NULL)) = 0 GROUP BY ALL),
        judged AS (
          SELECT *, regexp_extract(agg_count, '^\\s*(>=|<=|==|=|>|<)?\\s*(\\d+)\\s*$', 1) AS op,
                 CAST(regexp_extract(agg_count, '^\\s*(>=|<=|==|=|>|<)?\\s*(\\d+)\\s*$', 2) AS BIGINT) AS k FROM counted)
        SELECT source_file, rule_id, key_text FROM judged
        WHERE CASE op WHEN '>=' THEN n >= k WHEN '<=' THEN n <= k WHEN '>' THEN n > k WHEN '<' THEN n < k ELSE n = k END
    """,
    "p6_found": """
        WITH RECURSIVE latest AS (
          SELECT volume_id, entry_id, arg_max(struct_pack(b := base_entry_id, n := file_name), (collected_at, row_id)) AS r
          FROM mft_entries GROUP BY ALL),
        nodes AS (
          SELECT l.volume_id, l.entry_id, coalesce(r.n, '') AS name,
                 CASE WHEN r.b <> l.entry_id AND p.entry_id IS NOT NULL THEN r.b END AS parent
          FROM latest l LEFT JOIN (SELECT volume_id, entry_id FROM latest) p ON p.volume_id = l.volume_id AND p.entry_id = l.r.b),
        walk AS (
          SELECT volume_id, entry_id, entry_id AS root_entry_id, 0 AS node_depth, name AS node_path, [entry_id] AS above FROM nodes WHERE parent IS NULL
          UNION ALL
          SELECT n.volume_id, n.entry_id, w.root_entry_id, w.node_depth + 1, w.node_path || '\\' || n.name, list_append(w.above, n.entry_id)
          FROM walk w JOIN nodes n ON n.volume_id = w.volume_id AND n.parent = w.entry_id),
        under AS (
          SELECT volume_id, a AS entry_id, count(*) - 1 AS n_desc FROM (SELECT volume_id, unnest(above) AS a FROM walk) GROUP BY ALL)
        SELECT n.volume_id, n.entry_id, coalesce(w.root_entry_id, -1) AS root_entry_id, CAST(coalesce(w.node_depth, -1) AS INTEGER) AS node_depth,
               CAST(coalesce(u.n_desc, -1) AS INTEGER) AS n_desc, coalesce(w.node_path, '') AS node_path
        FROM nodes n LEFT JOIN walk w USING (volume_id, entry_id) LEFT JOIN under u USING (volume_id, entry_id)
    """,
    "p6_descendants": """
        WITH RECURSIVE latest AS (
          SELECT volume_id, entry_id, arg_max(struct_pack(b := base_entry_id), (collected_at, row_id)) AS r FROM mft_entries GROUP BY ALL),
        nodes AS (
          SELECT l.volume_id, l.entry_id, CASE WHEN r.b <> l.entry_id AND p.entry_id IS NOT NULL THEN r.b END AS parent
          FROM latest l LEFT JOIN (SELECT volume_id, entry_id FROM latest) p ON p.volume_id = l.volume_id AND p.entry_id = l.r.b),
        walk AS (
          SELECT volume_id, entry_id, CAST([] AS BIGINT[]) AS above FROM nodes WHERE parent IS NULL
          UNION ALL
          SELECT n.volume_id, n.entry_id, list_prepend(w.entry_id, w.above) FROM walk w JOIN nodes n ON n.volume_id = w.volume_id AND n.parent = w.entry_id)
        SELECT volume_id, above[i] AS ancestor, entry_id, CAST(i AS INTEGER) AS distance
        FROM (SELECT volume_id, entry_id, above, unnest(range(1, len(above) + 1)) AS i FROM walk)
    """,
}
