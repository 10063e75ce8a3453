"""Queries that exercise the hunting engine's operators over the test tables, with their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.analyse import timeline as tl
from tracequarry.analyse import usage
from tracequarry.functions import forensic as fx
from tracequarry.operators.hunt import aggregate_documents, aggregate_hits, hunt, run_summary
from tracequarry.operators.search import search
from tracequarry.rules import sigma
from tracequarry.rules.compile import Compiler, TypedFields, VariantFields, documents_from_json, double_text
from tracequarry.rules.ir import And, CastOk, Compare, Exists, Matrix, Nested, Node, Not, Null, Number, Or, Text
from tracequarry.rules.mapper import map_fields, parse_mapping
from tracequarry.rules.parse import Container, FieldSpec, parse_filter, parse_kv, parse_rule
from tracequarry.runtime import shared_folder, table
from tracequarry.sources import files, sinks
from tracequarry.sources.sinks import as_json, hit_records, hunt_table
from tracequarry.streaming.hunting import count_in_windows, hunt_stream, table_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _where(df: DataFrame, node: Node) -> DataFrame:
    return df.where(Compiler(TypedFields(df.schema)).predicate(node))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def tau_eq(spark, folder):
    return _where(_events(spark, folder), parse_filter({"event_type": "error"})).select("event_id", "user_id")


@query("SELECT event_id, value FROM events WHERE value >= 50 AND user_id < 40")
def tau_cmp(spark, folder):
    return _where(_events(spark, folder), And((parse_kv("value: >=50"), parse_kv("user_id: <40")))).select("event_id", "value")


@query("SELECT event_id FROM events WHERE NOT coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE) = 5, false) AND NOT coalesce(event_type = 'click', false)")
def tau_not(spark, folder):
    return _where(_events(spark, folder), And((Not(Compare("props.k", "==", 5)), Not(Text("event_type", "exact", "click"))))).select("event_id")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'signup') OR user_id = 7")
def tau_in_or(spark, folder):
    node = parse_filter({"condition": "kinds or user", "kinds": {"event_type": ["click", "view", "signup"]}, "user": {"user_id": 7}})
    return _where(_events(spark, folder), node).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) > 80")
def tau_nested_props(spark, folder):
    return _where(_events(spark, folder), Nested("props", Compare("k", ">", 80, True))).select("event_id")


@query("SELECT count(*) FILTER (props IS NOT NULL) AS n_props, count(*) FILTER (try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL) AS n_int, count(*) FILTER (json_extract_string(props, '$.z') IS NOT NULL) AS n_missing FROM events")
def field_exists_cast(spark, folder):
    df = _events(spark, folder)
    c = Compiler(TypedFields(df.schema))
    count = lambda node: F.sum(c.truth(node).cast("int")).cast("bigint")
    return df.agg(count(Exists("props")).alias("n_props"), count(CastOk("int", "props.k")).alias("n_int"), count(Exists("props.z")).alias("n_missing"))


@query("SELECT event_id FROM events WHERE (event_type = 'error' AND user_id = 3) OR (event_type = 'click' AND user_id = 4)")
def matrix(spark, folder):
    node = Matrix(("event_type", "user_id"), ((("exact", "error"), ("exact", "3")), (("exact", "click"), ("exact", "4"))))
    return _where(_events(spark, folder), node).select("event_id")


@query("SELECT row_id, computer FROM hunt_docs WHERE json_valid(doc_data) AND try_cast(json_extract_string(doc_data, '$.Event.System.EventID') AS DOUBLE) = 4625 AND lower(json_extract_string(doc_data, '$.Event.EventData.TargetUserName')) LIKE '%a%'")
def variant_documents(spark, folder):
    df = documents_from_json(table(spark, folder, "hunt_docs"), "doc_data")
    node = parse_filter({"Event.System.EventID": 4625, "Event.EventData.TargetUserName": "i*a*"})
    return df.where(Compiler(VariantFields("data")).predicate(node)).select("row_id", "computer")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'event (id|log)')")
def search_regex(spark, folder):
    d = table(spark, folder, "documents")
    return search(d, ["event (id|log)"], text=F.col("text")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'registry', 'i') OR regexp_matches(text, '4624', 'i')")
def search_any_icase(spark, folder):
    d = table(spark, folder, "documents")
    return search(d, ["registry", "4624"], ignore_case=True, match_any=True, text=F.col("text")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'image') AND regexp_matches(text, 'copy') AND lang = 'en'")
def search_all_with_term(spark, folder):
    d = table(spark, folder, "documents")
    return search(d, ["image", "copy"], ["lang: en"], text=F.col("text")).select("doc_id")


@query("SELECT event_id FROM events WHERE regexp_matches(event_type, 'err') AND ts > TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-05 12:00:00'")
def search_time_range(spark, folder):
    return search(_events(spark, folder), ['"event_type":"[^"]*err'], timestamp="ts", start="2024-01-02T00:00:00", end="2024-01-05T12:00:00").select("event_id")


@query("SELECT doc_id, contains(source, 'wiki') AS has_wiki, starts_with(source, 'forum') AS is_forum, ends_with(lower(source), '.example') AS is_example FROM documents WHERE contains(source, 'wiki') OR starts_with(source, 'forum') OR ends_with(lower(source), 'exroom.example')")
def search_text_tests(spark, folder):
    d = table(spark, folder, "documents")
    c = Compiler(TypedFields(d.schema))
    node = Or((Text("source", "contains", "wiki"), Text("source", "startswith", "forum"), Text("source", "endswith", "EXROOM.example", True)))
    shown = lambda how, v, i=False: c.truth(Text("source", how, v, i))
    return d.where(c.predicate(node)).select("doc_id", shown("contains", "wiki").alias("has_wiki"), shown("startswith", "forum").alias("is_forum"), shown("endswith", ".EXAMPLE", True).alias("is_example"))


_EVENT_FIELDS = [FieldSpec("k", "props", "k", None, Container("props", "json")), FieldSpec("kind", "kind", "event_type"), FieldSpec("usr", "usr", "user_id", "int")]


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind, CAST(user_id AS VARCHAR) AS usr FROM events")
def mapper_container_json(spark, folder):
    return map_fields(_events(spark, folder), _EVENT_FIELDS, ["event_id"])


@query("SELECT doc_id, split_part(list_filter(string_split(split_part(page_url, '//', 2), '/'), lambda x: starts_with(x, 'index'))[1], 'index', 2) AS after FROM documents WHERE page_url IS NOT NULL AND len(list_filter(string_split(split_part(page_url, '//', 2), '/'), lambda x: starts_with(x, 'index'))) > 0")
def mapper_container_kv(spark, folder):
    d = table(spark, folder, "documents")
    specs = [FieldSpec("after", "page_url", "index", None, Container("page_url", "kv", "/", ""))]
    return map_fields(d, specs, ["doc_id"]).where("after IS NOT NULL")


def _rules() -> list:
    base = {"group": "Demo", "kind": "json", "status": "stable", "timestamp": "ts"}
    return [
        parse_rule({**base, "name": "Errors", "level": "high", "filter": {"condition": "a", "a": {"event_type": "error"}}}),
        parse_rule({**base, "name": "Dear purchases", "level": "medium", "filter": {"condition": "a and not b", "a": {"event_type": "purchase"}, "b": {"value": "<20"}}}),
        parse_rule({**base, "name": "Low k", "level": "low", "status": "experimental", "filter": {"condition": "a and not b", "a": {"int(props.k)": "<10"}, "b": {"event_type": ["view", "click"]}}}),
        parse_rule({**base, "name": "Busy user", "level": "critical", "filter": {"condition": "a", "a": {"event_type": "error"}}, "aggregate": {"count": ">=3", "fields": ["user_id"]}}),
    ]


_RULE_SQL = {
    "Errors": ("high", "stable", "event_type = 'error'"),
    "Dear purchases": ("medium", "stable", "event_type = 'purchase' AND NOT coalesce(value < 20, false)"),
    "Low k": ("low", "experimental", "try_cast(json_extract_string(props, '$.k') AS DOUBLE) < 10 AND NOT coalesce(event_type IN ('view','click'), false)"),
    "Busy user": ("critical", "stable", "event_type = 'error'"),
}
_HITS = " UNION ALL ".join(f"SELECT event_id, user_id, ts, '{n}' AS rule, '{lv}' AS level, '{st}' AS status FROM events WHERE {w}" for n, (lv, st, w) in _RULE_SQL.items())


@query(f"SELECT event_id, rule, level, status FROM ({_HITS})")
def hunt_multi_rule(spark, folder):
    return hunt(_events(spark, folder), _rules()).select("event_id", "rule", "level", "status")


@query(f"SELECT event_id, rule FROM ({_HITS}) WHERE level IN ('high', 'low') AND ts > TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20'")
def hunt_levels_time(spark, folder):
    return hunt(_events(spark, folder), _rules(), levels=["high", "low"], timestamp="ts", start="2024-01-02", end="2024-01-20").select("event_id", "rule")


@query(f"SELECT rule, CAST(user_id AS VARCHAR) AS usr, count(*) AS n_docs, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen FROM ({_HITS}) WHERE rule = 'Busy user' GROUP BY ALL HAVING count(*) >= 3")
def hunt_aggregate(spark, folder):
    rules = _rules()
    hits = hunt(_events(spark, folder), rules)
    out = aggregate_hits(hits, rules, "ts")
    return out.select("rule", F.col("key")[0].alias("usr"), "n_docs", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_seen"))


@query(f"SELECT count(*) AS n_hits, count(DISTINCT user_id) AS n_sources, count(DISTINCT rule) AS n_rules FROM ({_HITS})")
def hunt_summary(spark, folder):
    return run_summary(hunt(_events(spark, folder), _rules()), "user_id")


_SIGMA = """
title: Odd types
status: stable
level: medium
logsource: {product: demo}
detection:
  sel_a: {event_type|startswith: [Err, sign]}
  sel_b: {event_type|endswith: ase}
  filter: {user_id: 5}
  condition: 1 of sel_* and not filter
---
title: All of it
status: test
level: high
logsource: {product: other}
detection:
  selection: {event_type|contains|all: [i, e]}
  condition: all of them
---
title: Left out
detection:
  selection: {event_type: view}
  condition: selection
"""
_MAPPING = {
    "kind": "json", "rules": "sigma", "exclusions": ["Left out"],
    "extensions": {"preconditions": [{"for": {"logsource.product": "other"}, "filter": {"user_id": "<30"}}]},
    "groups": [{"name": "Events", "timestamp": "ts", "filter": {"value": ">1"}, "fields": []}],
}


@query("""SELECT event_id, rule, hunt FROM (
    SELECT event_id, 'Odd types' AS rule, 'Events' AS hunt FROM events WHERE value > 1 AND (starts_with(event_type, 'err') OR starts_with(event_type, 'sign') OR ends_with(event_type, 'ase')) AND NOT coalesce(user_id = 5, false)
    UNION ALL SELECT event_id, 'All of it', 'Events' FROM events WHERE value > 1 AND user_id < 30 AND contains(event_type, 'i') AND contains(event_type, 'e'))""")
def sigma_hunt(spark, folder):
    return hunt(_events(spark, folder), sigma.load(_SIGMA), [parse_mapping(_MAPPING)], kind="json").select("event_id", "rule", "hunt")


@query("SELECT user_id AS usr, count(*) AS n_docs FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 4")
def sigma_count_by(spark, folder):
    rules = sigma.load("title: Many\ndetection:\n  s: {event_type: error}\n  condition: s | count() by user_id > 4\n")
    mapping = parse_mapping({"kind": "json", "rules": "sigma", "groups": [{"name": "E", "timestamp": "ts", "filter": {"event_type": "*"}}]})
    hits = hunt(_events(spark, folder), rules, [mapping])
    return aggregate_hits(hits, rules, "ts").select(F.col("key")[0].cast("bigint").alias("usr"), "n_docs")


@query("""SELECT row_id, CASE WHEN contains(doc_data, 'bG9nb24') OR contains(doc_data, 'xvZ29u') OR contains(doc_data, 'sb2dvb') THEN true ELSE false END AS hit FROM hunt_docs""")
def sigma_base64offset(spark, folder):
    node = parse_filter(sigma.to_filter({"s": {"doc_data|base64offset": "logon"}, "condition": "s"})[0])
    d = table(spark, folder, "hunt_docs")
    return d.select("row_id", Compiler(TypedFields(d.schema)).truth(node).alias("hit"))


_ANCHORED = """
  SELECT computer, cache_entry_position AS pos, row_id, entry_path, last_modified_ts,
         CASE WHEN regexp_matches(lower(entry_path), 'loader|patch') AND last_modified_ts IS NOT NULL THEN last_modified_ts END AS exact_ts
  FROM shim_entries"""


@query(f"""WITH a AS ({_ANCHORED}), w AS (
    SELECT *, last_value(exact_ts IGNORE NULLS) OVER (PARTITION BY computer ORDER BY pos, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newer,
           first_value(exact_ts IGNORE NULLS) OVER (PARTITION BY computer ORDER BY pos, row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS older FROM a)
  SELECT row_id, CASE WHEN exact_ts IS NOT NULL THEN 'Exact' WHEN newer IS NOT NULL AND older IS NOT NULL THEN 'Range' WHEN older IS NOT NULL THEN 'RangeStart' WHEN newer IS NOT NULL THEN 'RangeEnd' END AS ts_kind,
         strftime(CASE WHEN exact_ts IS NULL THEN older END, '%Y-%m-%d %H:%M:%S.%f') AS range_from, strftime(CASE WHEN exact_ts IS NULL THEN newer END, '%Y-%m-%d %H:%M:%S.%f') AS range_to FROM w""")
def timeline_ranges(spark, folder):
    e = table(spark, folder, "shim_entries").withColumn("position", F.struct("cache_entry_position", "row_id"))
    out = tl.fill_ranges(tl.anchor(e, ["loader|patch"], "entry_path", "last_modified_ts"), "computer", "position")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("row_id", "ts_kind", shown("range_from"), shown("range_to"))


@query("""SELECT a.row_id AS row_id, f.full_path AS found FROM shim_entries a LEFT JOIN (
    SELECT lower(full_path) AS k, arg_max(full_path, row_id) AS full_path FROM mft_entries WHERE full_path IS NOT NULL GROUP BY ALL) f ON lower(a.entry_path) = f.k""")
def timeline_lookup(spark, folder):
    files = table(spark, folder, "mft_entries").select(F.col("full_path").alias("file_path"), F.col("full_path").alias("found"), "row_id")
    e = table(spark, folder, "shim_entries").select("row_id", "entry_path")
    return tl.attach_files(e, files, "entry_path", "file_path", ["row_id"]).select("row_id", "found")


@query("""SELECT s.event_id AS event_id, t.event_id AS other FROM events s JOIN events t ON t.user_id = s.user_id AND t.event_type = 'purchase' WHERE s.event_type = 'error' AND abs(epoch_ms(s.ts) - epoch_ms(t.ts)) <= 600000""")
def near_pair(spark, folder):
    e = _events(spark, folder)
    a = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("other"), "user_id", F.col("ts").alias("other_ts"))
    return tl.near_pairs(a, b, "user_id", "ts", "other_ts", 600).select("event_id", "other")


@query("""WITH ids AS (SELECT key_id, arg_max(struct_pack(v := value_data), row_id).v AS id_text FROM reg_values WHERE key_id IS NOT NULL GROUP BY ALL),
    people AS (SELECT target_user AS sid, max(computer) AS user_name FROM agg_hits GROUP BY ALL),
    names AS (SELECT upper(guid) AS g, max(table_name) AS n FROM table_details WHERE guid IS NOT NULL GROUP BY ALL)
  SELECT d.row_id AS row_id, a.id_text AS app_name, u.id_text AS user_sid, p.user_name AS user_name,
         n.n || CASE WHEN regexp_matches(d.guid, 'LT$', 'i') THEN ' (Long Term)' ELSE '' END AS table_name
  FROM (SELECT row_id, guid, row_id % 5000 AS app_id, row_id % 7000 AS user_id FROM table_details) d LEFT JOIN ids a ON d.app_id = a.key_id LEFT JOIN ids u ON d.user_id = u.key_id
  LEFT JOIN people p ON u.id_text = p.sid LEFT JOIN names n ON upper(regexp_replace(d.guid, 'LT$', '', 'i')) = n.g""")
def usage_lookup(spark, folder):
    """Usage records with the names of their ids, users and tables; registry values stand in for the id map."""
    d = table(spark, folder, "table_details")
    facts = d.select("row_id", F.col("guid").alias("table"), (F.col("row_id") % 5000).alias("app_id"), (F.col("row_id") % 7000).alias("user_id"))
    ids = table(spark, folder, "reg_values").select(F.col("key_id").alias("id_index"), F.col("value_data").alias("id_text"), "row_id")
    users = table(spark, folder, "agg_hits").select(F.col("target_user").alias("sid"), F.col("computer").alias("user"))
    out = usage.enrich(facts, ids, users, d)
    return out.select("row_id", "app_name", "user_sid", "user_name", "table_name")


@query("""WITH frames AS (SELECT upper(guid) AS guid, min(time_from) AS first_seen, max(time_from) AS last_seen, count(*) AS n_records FROM table_details GROUP BY ALL),
    known AS (SELECT upper(guid) AS guid, max(table_name) AS table_name, max(retention_time_days) AS days, max(dll_path) AS dll_path FROM table_details WHERE guid IS NOT NULL GROUP BY ALL)
  SELECT k.guid AS guid, table_name, dll_path, days AS retention_time_days, first_seen, last_seen, n_records, CASE WHEN days IS NULL THEN '' ELSE
    concat_ws(', ', CASE WHEN x // 1440 > 0 THEN (x // 1440) || ' days' END, CASE WHEN x % 1440 // 60 > 0 THEN (x % 1440 // 60) || ' hours' END, CASE WHEN x % 60 > 0 THEN (x % 60) || ' minutes' END) END AS retention
  FROM (SELECT *, CAST(round(days * 1440) AS BIGINT) AS x FROM known) k LEFT JOIN frames f ON k.guid = f.guid""")
def usage_details(spark, folder):
    d = table(spark, folder, "table_details")
    return usage.details(usage.time_frames(d, "guid", "time_from"), d)


@query("SELECT upper(event_type) AS guid, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, count(*) AS n_records FROM events GROUP BY ALL")
def usage_time_frames(spark, folder):
    out = usage.time_frames(_events(spark, folder), "event_type", "ts")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("guid", shown("first_seen"), shown("last_seen"), "n_records")


@query("""WITH m AS (SELECT row_id, CAST(round(retention_time_days * 1440) AS BIGINT) AS x FROM table_details)
  SELECT row_id, concat_ws(', ', CASE WHEN x // 1440 > 0 THEN (x // 1440) || ' days' END, CASE WHEN x % 1440 // 60 > 0 THEN (x % 1440 // 60) || ' hours' END, CASE WHEN x % 60 > 0 THEN (x % 60) || ' minutes' END) AS retention FROM m""")
def usage_retention(spark, folder):
    return table(spark, folder, "table_details").select("row_id", fx.format_duration(F.col("retention_time_days")).alias("retention"))


@query("""SELECT row_id, coalesce(hard_link_count, used_entry_size, 3600) * coalesce(total_entry_size, 1440.0) / 3600 / 24 AS plain, coalesce(hard_link_count, used_entry_size, 604800) * coalesce(total_entry_size, 260.0) / 3600 / 24 AS long_term FROM mft_entries""")
def usage_retention_order(spark, folder):
    """Own settings before common ones before the defaults; entry counts stand in for the settings."""
    m = table(spark, folder, "mft_entries")
    own, common = (F.col("hard_link_count"), F.lit(None).cast("int")), (F.col("used_entry_size"), F.col("total_entry_size"))
    return m.select("row_id", fx.retention_days(own, common).alias("plain"), fx.retention_days(own, common, "Tier2LongTerm").alias("long_term"))


@query("""SELECT row_id, CASE WHEN ft > 0 THEN CASE WHEN year(t) > 9999 THEN '+' ELSE '' END || strftime(t, '%Y-%m-%dT%H:%M:%S.%fZ') END AS created
  FROM (SELECT row_id, file_name_created_ft AS ft, make_timestamp(file_name_created_ft // 10 - 11644473600000000) AS t FROM mft_entries)""")
def filetime_text(spark, folder):
    """FILETIMEs of all rows: null for null, 0 and negative, far dates with a sign."""
    return table(spark, folder, "mft_entries").select("row_id", fx.filetime_micros(F.col("file_name_created_ft")).alias("created"))


@query("""SELECT row_id, CASE WHEN ft > 0 AND ft // 10000000 - 11644473600 < 16756761600 THEN strftime(make_timestamp((ft // 10000000 - 11644473600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS seconds,
    CASE WHEN d BETWEEN 25569 AND 219146 THEN strftime(make_timestamp(CAST(floor((d - 25569) * 86400) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS ole
  FROM (SELECT row_id, file_name_created_ft AS ft, row_id * 0.75 AS d FROM mft_entries)""")
def filetime_seconds_ole(spark, folder):
    m = table(spark, folder, "mft_entries")
    days = F.col("row_id") * F.lit(0.75).cast("decimal(10,2)")
    return m.select("row_id", fx.filetime_seconds(F.col("file_name_created_ft")).alias("seconds"), fx.ole_date(days).alias("ole"))


_FLAGS = " ".join(f"CASE WHEN n & {b} <> 0 THEN '{name}' END," for b, name in fx.FILE_FLAGS).rstrip(",")


@query(f"""SELECT row_id, CASE WHEN n IS NOT NULL THEN CASE WHEN names = '' THEN 'NONE' ELSE names END END AS flags,
    CASE WHEN hard_link_count IS NOT NULL THEN CASE WHEN hard_link_count & 3 = 0 THEN 'NONE' ELSE concat_ws(' | ', CASE WHEN hard_link_count & 1 <> 0 THEN 'ALLOCATED' END, CASE WHEN hard_link_count & 2 <> 0 THEN 'INDEX_PRESENT' END) END END AS entry_flags
  FROM (SELECT row_id, hard_link_count, n, concat_ws(' | ', {_FLAGS}) AS names FROM (SELECT row_id, hard_link_count, CAST(used_entry_size AS BIGINT) * 524288 AS n FROM mft_entries))""")
def flag_texts(spark, folder):
    m = table(spark, folder, "mft_entries")
    bits = F.col("used_entry_size").cast("bigint") * 524_288
    return m.select("row_id", fx.flag_names(bits).alias("flags"), fx.flag_names(F.col("hard_link_count"), fx.ENTRY_FLAGS).alias("entry_flags"))


@query("""SELECT row_id, 'S-1-5-21-' || (entry_id % 4294967296) || '-' || (row_id % 4294967296) AS sid FROM mft_entries""")
def sid_texts(spark, folder):
    """Binary identifiers put together from entry numbers, as text."""
    m = table(spark, folder, "mft_entries")
    little = lambda n: F.concat(*[F.lpad(F.hex(F.floor(n / 256**i).cast("bigint") % 256), 2, "0") for i in range(4)])
    binary = F.unhex(F.concat(F.lit("010300000000000515000000"), little(F.col("entry_id") % 2**32), little(F.col("row_id") % 2**32)))
    return m.select("row_id", fx.sid_text(binary).alias("sid"))


@query("""SELECT row_id, regexp_replace(regexp_replace(entry_path, '^\\\\\\?\\?\\\\', ''), '^SYSVOL\\\\', 'C:\\\\') AS path,
    regexp_extract(replace(entry_path, '\\', '/'), '[^/]+$') AS last_part, program_entry IS NOT NULL AND length(program_entry) >= 50 AND regexp_matches(program_entry, '^[0-9A-Fa-f]{8}\\b') AND len(regexp_split_to_array(trim(program_entry), '\\s+')) >= 6 AS is_program FROM shim_entries""")
def path_rewrites(spark, folder):
    s = table(spark, folder, "shim_entries")
    program = F.coalesce(fx.is_program_entry(F.col("program_entry")), F.lit(False))
    return s.select("row_id", fx.clean_path(F.col("entry_path")).alias("path"), fx.last_path_part(F.col("entry_path")).alias("last_part"), program.alias("is_program"))


@query("""WITH p AS (SELECT row_id, CASE WHEN length(program_entry) >= 50 AND regexp_matches(program_entry, '^[0-9A-Fa-f]{8}\\b') THEN regexp_split_to_array(trim(program_entry), '\\s+') END AS x FROM shim_entries),
    q AS (SELECT row_id, CASE WHEN len(x) >= 6 THEN x END AS x FROM p)
  SELECT row_id, x[5] AS program_name, x[6] AS publisher_id, CASE WHEN len(x) >= 7 THEN x[7] = 'neutral' END AS neutral,
    CASE WHEN regexp_matches(x[4], '^[0-9A-Fa-f]{4}$') THEN CASE ('0x' || x[4])::INT WHEN 34404 THEN 'AMD64' WHEN 452 THEN 'ARM' WHEN 332 THEN 'I386' WHEN 512 THEN 'IA64' ELSE 'Unknown (' || ('0x' || x[4])::INT || ')' END END AS architecture,
    CASE WHEN regexp_matches(x[2], '^[0-9A-Fa-f]{16}$') THEN concat_ws('.', CAST('0x' || x[2][1:4] AS INT), CAST('0x' || x[2][5:8] AS INT), CAST('0x' || x[2][9:12] AS INT), CAST('0x' || x[2][13:16] AS INT)) ELSE x[2] END AS program_version FROM q""")
def program_entries(spark, folder):
    f = fx.program_fields(F.col("program_entry"))
    return table(spark, folder, "shim_entries").select("row_id", *[f[c].alias(c) for c in ("program_name", "publisher_id", "neutral", "architecture", "program_version")])


@query("""SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M') AS window_start, rule, user_id, count(*) AS n_hits FROM (SELECT ts, 'Errors' AS rule, user_id FROM events WHERE event_type = 'error') GROUP BY ALL HAVING count(*) >= 2""")
def windowed_counts(spark, folder):
    hits = hunt(_events(spark, folder), [_rules()[0]])
    out = count_in_windows(hits, "ts", ["user_id"], "5 minutes", least=2)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "rule", "user_id", "n_hits")


@query("""SELECT row_id, '{' || concat_ws(',', '"row_id":' || row_id, '"source_file":' || to_json(source_file), '"doc_kind":' || to_json(doc_kind), '"computer":' || to_json(computer), '"record_id":' || record_id) || '}' AS document FROM hunt_docs""")
def dump_documents(spark, folder):
    """Every document's head as one compact JSON text."""
    d = table(spark, folder, "hunt_docs").select("row_id", "source_file", "doc_kind", "computer", "record_id")
    return d.select("row_id", as_json(d).alias("document"))


# --- rules over mapped and nested documents -------------------------------------------------------

_MAPPED = """
title: Logon of a user
level: high
status: stable
logsource: {product: windows}
detection:
  s: {TargetUserName|contains: a, EventID: 4625}
  condition: s
---
title: Many kinds
level: low
status: stable
detection:
  s: {EventID: [4624, 4688, 7045]}
  f: {Provider|startswith: Micro}
  condition: s and not f
---
title: Deep
level: medium
status: stable
detection:
  s: {Number: '4625'}
  condition: s
"""
_DOC_MAPPING = {
    "kind": "evtx", "rules": "sigma",
    "groups": [{"name": "Documents", "timestamp": "Time", "filter": {"Computer": "*"}, "fields": [
        {"from": "TargetUserName", "to": "Event.EventData.TargetUserName"}, {"from": "EventID", "to": "Event.System.EventID"}, {"from": "Provider", "to": "Event.System.Provider_attributes.Name"},
        {"from": "Computer", "to": "Event.System.Computer"}, {"from": "Number", "to": "str(Event.System.EventID)"}, {"from": "Time", "to": "Event.System.TimeCreated_attributes.SystemTime"},
    ]}],
}
_DOC = "json_extract_string(doc_data, '$.Event.{}')".format


@query(f"""WITH d AS (SELECT row_id, {_DOC('System.EventID')} AS id, {_DOC('EventData.TargetUserName')} AS usr, {_DOC('System.Provider_attributes.Name')} AS provider FROM hunt_docs
    WHERE json_valid(doc_data) AND {_DOC('System.Computer')} IS NOT NULL)
  SELECT row_id, 'Logon of a user' AS rule FROM d WHERE lower(usr) LIKE '%a%' AND id = '4625'
  UNION ALL SELECT row_id, 'Many kinds' FROM d WHERE id IN ('4624', '4688', '7045') AND NOT coalesce(lower(provider) LIKE 'micro%', false)
  UNION ALL SELECT row_id, 'Deep' FROM d WHERE id = '4625'""")
def sigma_mapped_hunt(spark, folder):
    """Rules in the terms of a mapping over nested event-log documents."""
    docs = documents_from_json(table(spark, folder, "hunt_docs"), "doc_data")
    return hunt(docs, sigma.load(_MAPPED), [parse_mapping(_DOC_MAPPING)], variant="data").select("row_id", "rule")


@query(f"""SELECT row_id, 'Logon of a user' AS rule, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS hit_ts FROM (
    SELECT row_id, try_cast(regexp_replace({_DOC('System.TimeCreated_attributes.SystemTime')}, '^(\\d{{4}}-\\d\\d-\\d\\d)[T ](\\d\\d:\\d\\d:\\d\\d)(\\.\\d{{1,6}})?.*$', '\\1 \\2\\3') AS TIMESTAMP) AS ts
    FROM hunt_docs WHERE json_valid(doc_data) AND {_DOC('System.Computer')} IS NOT NULL AND lower({_DOC('EventData.TargetUserName')}) LIKE '%a%' AND {_DOC('System.EventID')} = '4625')
  WHERE ts > TIMESTAMP '2020-06-01' AND ts < TIMESTAMP '2025-06-01'""")
def hunt_own_time(spark, folder):
    """The mapping group's own time decides on the range."""
    docs = documents_from_json(table(spark, folder, "hunt_docs"), "doc_data")
    out = hunt(docs, sigma.load(_MAPPED)[:1], [parse_mapping(_DOC_MAPPING)], variant="data", own_time=True, start="2020-06-01", end="2025-06-01")
    return out.select("row_id", "rule", F.date_format("hit_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("hit_ts"))


def _many_rules() -> list:
    base = {"group": "Many", "kind": "json", "level": "low", "status": "stable"}
    kinds = ["click", "error", "purchase"]
    return [parse_rule({**base, "name": f"u{i}", "filter": {"condition": "a", "a": {"user_id": i, "event_type": kinds[i % 3]}}}) for i in range(500)]


@query("SELECT event_id, 'u' || user_id AS rule FROM events WHERE user_id BETWEEN 0 AND 499 AND event_type = CASE user_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'error' ELSE 'purchase' END")
def hunt_500_rules(spark, folder):
    return hunt(_events(spark, folder), _many_rules()).select("event_id", "rule")


@query(f"""WITH h AS ({_HITS}), g AS (SELECT rule, user_id, count(*) AS n_docs, min(ts) AS t FROM h WHERE rule = 'Busy user' GROUP BY ALL HAVING count(*) >= 3)
  SELECT event_id, h.rule AS rule, CAST(h.user_id AS VARCHAR) AS usr, n_docs, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS first_seen FROM h JOIN g ON h.rule = g.rule AND h.user_id = g.user_id""")
def hunt_aggregate_documents(spark, folder):
    """The documents of every group that meets its rule's count."""
    rules = _rules()
    out = aggregate_documents(hunt(_events(spark, folder), rules, with_keys=True), rules, "ts")
    return out.select("event_id", "rule", F.col("key")[0].alias("usr"), "n_docs", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_seen"))


@query(f"""SELECT event_id, rule, CASE rule WHEN 'Errors' THEN 'ann' END AS author, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts, 'Demo' AS grp, 'individual' AS kind FROM ({_HITS})""")
def hunt_records(spark, folder):
    rules = _rules()
    rules[0] = replace(rules[0], authors=("ann", "bob"))
    r = hit_records(hunt(_events(spark, folder), rules), ["event_id"], "ts", rules)
    return r.select("document.event_id", F.col("name").alias("rule"), F.get("authors", F.lit(0)).alias("author"), F.col("timestamp").alias("ts"), F.col("group").alias("grp"), "kind")


@query("""SELECT event_id, regexp_matches(event_type, '^(cl|vi)') AS a, regexp_matches(event_type, 'ERR', 'i') AS b, value <= 40.5 AS c, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT) <= 20, false) AS d,
    value > 60.25 AS e, event_type IS NOT NULL AND NOT (user_id <= 10) AS f, CAST(user_id AS VARCHAR) LIKE '%7%' AS g, true AS h, false AS i FROM events""")
def tau_patterns(spark, folder):
    """Patterns and literals of rules: regular expressions on fields, at most, whole and decimal, text of numbers."""
    df = _events(spark, folder)
    c = Compiler(TypedFields(df.schema))
    shown = {
        "a": parse_filter({"event_type": "?^(cl|vi)"}), "b": parse_filter({"event_type": "i?ERR"}), "c": parse_kv("flt(value): <=40.5"), "d": Compare("props.k", "<=", 20, True),
        "e": parse_kv("value: >60.25"), "f": And((Exists("event_type"), Not(Compare("user_id", "<=", 10, True)))), "g": Text("user_id", "contains", "7"), "h": Number(3), "i": Null(),
    }
    return df.select("event_id", *[c.truth(n).alias(k) for k, n in shown.items()])


@query("""SELECT event_id, CASE WHEN value = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.' || greatest(0, 5 - CAST(floor(log10(abs(value))) AS INT)) || 'f', value), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') END AS shown
  FROM events""")
def number_texts(spark, folder):
    """Floating-point values as the texts that rules compare."""
    e = _events(spark, folder)
    return e.select("event_id", double_text(F.col("value")).alias("shown"))


@query("""SELECT row_id, lower(hex(encode(file_name))) AS bytes, file_name AS wide, CASE WHEN length(full_path) = 44 AND starts_with(full_path, '0000') THEN full_path[5:44] END AS sha1 FROM mft_entries""")
def byte_texts(spark, folder):
    """Bytes as hex, UTF-16 bytes as text, hashes out of file ids (which paths are not)."""
    m = table(spark, folder, "mft_entries")
    return m.select("row_id", fx.bytes_to_hex(F.encode("file_name", "UTF-8")).alias("bytes"), fx.utf16_text(F.encode("file_name", "UTF-16LE")).alias("wide"), fx.sha1_of_file_id(F.col("full_path")).alias("sha1"))


@query("""SELECT row_id, CASE WHEN length(value_data) = 44 AND starts_with(value_data, '0000') THEN substring(value_data, 5, 40) END AS sha1 FROM reg_values""")
def file_hashes(spark, folder):
    return table(spark, folder, "reg_values").select("row_id", fx.sha1_of_file_id(F.col("value_data")).alias("sha1"))


@query("""SELECT row_id, sha256(concat_ws(chr(0), source_file, coalesce(CAST(record_id AS VARCHAR), ''))) AS record_key FROM hunt_docs""")
def record_keys(spark, folder):
    return table(spark, folder, "hunt_docs").select("row_id", fx.record_key(F.col("source_file"), F.col("record_id")).alias("record_key"))


@query("""SELECT row_id, CASE WHEN n >= 1099511627776 THEN printf('%.2f', n / 1099511627776) || ' TB' WHEN n >= 1073741824 THEN printf('%.2f', n / 1073741824) || ' GB' WHEN n >= 1048576 THEN printf('%.2f', n / 1048576) || ' MB'
    WHEN n >= 1024 THEN printf('%.2f', n / 1024) || ' KB' ELSE n || ' B' END AS size FROM (SELECT row_id, file_size AS n FROM mft_entries)""")
def size_texts(spark, folder):
    return table(spark, folder, "mft_entries").select("row_id", fx.size_text(F.col("file_size")).alias("size"))


@query("""SELECT doc_id, substring(regexp_replace(text, '[\\n\\r\\t ]+', ' ', 'g'), 1, 496) AS shown FROM documents""")
def collapsed_texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", fx.collapse(F.col("text")).alias("shown"))


@query("""SELECT row_id, coalesce(CAST(try_cast(regexp_extract(time_from, '^\\s*([+-]?\\d+)', 1) AS BIGINT) AS VARCHAR), time_from) AS whole, printf('%.6f', retention_time_days) AS shown, time_from AS same FROM table_details""")
def mapper_casts(spark, folder):
    specs = [FieldSpec("whole", "whole", "time_from", "int"), FieldSpec("shown", "shown", "retention_time_days", "str"), FieldSpec("same", "same", "time_from"), FieldSpec("hidden", "guid", "guid", visible=False)]
    return map_fields(table(spark, folder, "table_details"), specs, ["row_id"])


@query(f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'Demo: ' || rule AS detections, event_type FROM ({_HITS.replace('SELECT event_id', 'SELECT event_type, event_id')})""")
def hunt_report(spark, folder):
    """Hits as the columns of a report."""
    hits = hunt(_events(spark, folder).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), _rules())
    return hunt_table(hits, "ts", ["event_type"])


# --- whole timelines ------------------------------------------------------------------------------


def _fill(of: str, exact: str) -> str:
    return f"""SELECT *, last_value({exact} IGNORE NULLS) OVER w1 AS newer, first_value({exact} IGNORE NULLS) OVER w2 AS older FROM {of}
      WINDOW w1 AS (PARTITION BY computer ORDER BY pos, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY computer ORDER BY pos, row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""


@query(f"""WITH files AS (SELECT lower(full_path) AS k, arg_max(collected_at, row_id) AS file_ts FROM mft_entries WHERE full_path IS NOT NULL GROUP BY ALL),
    e AS (SELECT computer, cache_entry_position AS pos, row_id, entry_path, last_modified_ts AS m FROM shim_entries),
    a AS (SELECT e.*, file_ts, CASE WHEN regexp_matches(lower(entry_path), 'loader|patch') AND m IS NOT NULL THEN m END AS x0 FROM e LEFT JOIN files ON lower(entry_path) = k),
    b AS (SELECT *, CASE WHEN x0 IS NULL AND coalesce(abs(epoch_ms(m) - epoch_ms(file_ts)) <= 60000, false) THEN file_ts ELSE x0 END AS x1, CASE WHEN x0 IS NOT NULL THEN 'PatternMatch' WHEN coalesce(abs(epoch_ms(m) - epoch_ms(file_ts)) <= 60000, false) THEN 'NearTSMatch' END AS h1 FROM a),
    c AS ({_fill('b', 'x1')}),
    d AS (SELECT * EXCLUDE (newer, older), x1 IS NULL AND newer IS NOT NULL AND older IS NOT NULL AND coalesce(file_ts > older AND file_ts < newer, false) AS inside FROM c),
    f AS (SELECT *, CASE WHEN inside THEN file_ts ELSE x1 END AS x2, CASE WHEN inside THEN 'AmcacheRangeMatch' ELSE h1 END AS h2 FROM d),
    g AS ({_fill('f', 'x2')})
  SELECT row_id, h2 AS how, CASE WHEN x2 IS NOT NULL THEN 'Exact' WHEN newer IS NOT NULL AND older IS NOT NULL THEN 'Range' WHEN older IS NOT NULL THEN 'RangeStart' WHEN newer IS NOT NULL THEN 'RangeEnd' END AS ts_kind,
    strftime(coalesce(x2, older, newer), '%Y-%m-%d %H:%M:%S.%f') AS display_ts, CAST(row_number() OVER (PARTITION BY computer ORDER BY pos, row_id) AS INTEGER) AS entry_number FROM g""")
def timeline_whole(spark, folder):
    """Anchors, ranges, file lookup, near pairs, times inside ranges, and numbering; file-table entries stand in for the inventory."""
    e = table(spark, folder, "shim_entries").withColumn("position", F.struct("cache_entry_position", "row_id"))
    files = table(spark, folder, "mft_entries").select(F.col("full_path").alias("file_path"), F.col("collected_at").alias("file_ts"), F.col("row_id").alias("file_row"))
    out = tl.timeline(e, ["loader|patch"], files, True, "computer", "position", "entry_path", "last_modified_ts", file_order=["file_row"])
    return out.select("row_id", "how", "ts_kind", F.date_format("display_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("display_ts"), "entry_number")


@query("""WITH p AS (SELECT row_id, CASE WHEN length(program_entry) >= 50 AND regexp_matches(program_entry, '^[0-9A-Fa-f]{8}\\b') THEN regexp_split_to_array(trim(program_entry), '\\s+') END AS x FROM shim_entries),
    q AS (SELECT row_id, x[5] AS name, CASE WHEN regexp_matches(x[2], '^[0-9A-Fa-f]{16}$') THEN concat_ws('.', CAST('0x' || x[2][1:4] AS INT), CAST('0x' || x[2][5:8] AS INT), CAST('0x' || x[2][9:12] AS INT), CAST('0x' || x[2][13:16] AS INT)) ELSE x[2] END AS version FROM p WHERE len(x) >= 6),
    k AS (SELECT name, version, max(row_id) AS r FROM q GROUP BY ALL)
  SELECT s.row_id AS row_id, k.r AS found FROM shim_entries s LEFT JOIN q ON s.row_id = q.row_id LEFT JOIN k ON q.name = k.name AND q.version = k.version""")
def program_lookup(spark, folder):
    """Programs by name and version, the last of several; the cache's own program entries stand in for the inventory."""
    s = table(spark, folder, "shim_entries")
    f = fx.program_fields(F.col("program_entry"))
    e = s.select("row_id", f["program_name"].alias("program_name"), f["program_version"].alias("program_version"))
    programs = e.where("program_name IS NOT NULL").select("program_name", F.col("program_version").alias("version"), F.col("row_id").alias("found"))
    return tl.attach_programs(e, programs, ["found"]).select("row_id", "found")


# --- files and back -------------------------------------------------------------------------------


def _written(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_BACK = "SELECT event_id, event_type, value, user_id FROM events"


def _fields(docs: DataFrame) -> DataFrame:
    return docs.select(F.from_json("data", "event_id bigint, event_type string, value double, user_id bigint").alias("d")).select("d.*")


@query(_BACK)
def jsonl_round_trip(spark, folder):
    """All events written as JSON Lines and read back, in ranges."""
    to = _written(spark, "events")
    sinks.write_jsonl(_events(spark, folder).select("event_id", "event_type", "value", "user_id"), to)
    return _fields(files.read(spark, [to], "jsonl", split=1 << 20).where("data IS NOT NULL"))


@query(_BACK)
def json_round_trip(spark, folder):
    """All events written as one JSON array and read back."""
    to = _written(spark, "events")
    sinks.write_json_array(_events(spark, folder).select("event_id", "event_type", "value", "user_id"), to)
    return _fields(files.read(spark, [to], "json").where("data IS NOT NULL"))


@query(_BACK)
def csv_round_trip(spark, folder):
    """All events written as CSV and read back."""
    to = _written(spark, "events")
    e = _events(spark, folder).select("event_id", "event_type", "value", "user_id")
    sinks.write_csv(e, to)
    return spark.read.schema(e.schema).option("header", True).csv(to)


@query(_BACK)
def yaml_round_trip(spark, folder):
    """All events dumped as pretty documents behind ``---`` and read back."""
    to = _written(spark, "events")
    sinks.write_yaml(_events(spark, folder).select("event_id", "event_type", "value", "user_id"), to)
    return _fields(spark.read.option("lineSep", "---\n").text(to).where("trim(value) <> ''").withColumnRenamed("value", "data"))


@query("SELECT event_id, 'Errors' AS rule FROM events WHERE event_type = 'error'")
def stream_hunt(spark, folder):
    """All events as a stream: hits are written as they come and read back."""
    source = table(spark, folder, "events")
    stream = table_stream(spark, folder, "events", source.schema)
    to = _written(spark, "hits")
    hits = hunt_stream(stream, [_rules()[0]]).select("event_id", "rule")
    hits.writeStream.format("parquet").option("path", to).option("checkpointLocation", to + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(hits.schema).parquet(to)
