"""SQL for the shredded rows of problem 5, built level by level."""

from __future__ import annotations


def nested_rows() -> str:
    """The objects of all declared arrays: arrays, single objects and JSON texts of either, level by level."""
    arr = """CASE json_type({v}) WHEN 'ARRAY' THEN {v} WHEN 'OBJECT' THEN json_array({v})
        WHEN 'VARCHAR' THEN CASE WHEN json_valid({v} ->> '$') THEN CASE json_type(({v} ->> '$')::JSON) WHEN 'ARRAY' THEN ({v} ->> '$')::JSON WHEN 'OBJECT' THEN json_array(({v} ->> '$')::JSON) END END END"""
    ctes, outs = [], []
    def level(name, source, table, path, step, first):
        v = f"json_extract(elem, '{step}')" if step else "elem"
        ctes.append(f"""{name}_a AS (SELECT rec_id, ords, {arr.format(v='v')} AS arr FROM (SELECT rec_id, ords, {v} AS v FROM {source}))""")
        ctes.append(f"""{name} AS (SELECT rec_id, {"CAST(i AS VARCHAR)" if first else "ords || '.' || i"} AS ords, json_extract(arr, '$[' || i || ']') AS elem FROM (SELECT rec_id, ords, arr, unnest(range(CAST(json_array_length(arr) AS BIGINT))) AS i FROM {name}_a WHERE arr IS NOT NULL))""")
        outs.append(f"SELECT '{table}' AS rec_table, rec_id, '{path}' AS arr_path, ords AS ordinals FROM {name} WHERE json_type(elem) = 'OBJECT'")
    ctes.append("docs AS (SELECT row_id AS rec_id, '' AS ords, doc_data::JSON AS elem FROM hunt_docs WHERE json_valid(doc_data))")
    ctes.append("dbs AS (SELECT row_id AS rec_id, '' AS ords, db_content::JSON AS elem FROM srum_db WHERE json_valid(db_content))")
    h = "hunt_docs"
    level("priv", "docs", h, "Event.EventData.Privileges", "$.Event.EventData.Privileges", True)
    level("chg", "docs", h, "Event.UserData.Changes", "$.Event.UserData.Changes", True)
    level("act", "chg", h, "Event.UserData.Changes.Actors", "$.Actors", False)
    level("vals", "docs", h, "values", "$.values", True)
    level("proc", "docs", h, "Report.Processes", "$.Report.Processes", True)
    level("mods", "proc", h, "Report.Processes.Modules", "$.Modules", False)
    level("exps", "mods", h, "Report.Processes.Modules.Exports", "$.Exports", False)
    level("conn", "proc", h, "Report.Processes.Connections", "$.Connections", False)
    level("root", "dbs", "srum_db", "root", "", True)
    level("intv", "root", "srum_db", "root.Intervals", "$.Intervals", False)
    level("cnts", "intv", "srum_db", "root.Intervals.Counters", "$.Counters", False)
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(outs)
