import json

import builders as make
import pytest

from tracequarry import cli

RULE = """
title: Logons
group: Auth
kind: evtx
level: high
status: stable
authors: [ann]
timestamp: Event.System.TimeCreated_attributes.SystemTime
fields: [{name: User, from: User, to: Event.EventData.TargetUserName}]
filter: {condition: s, s: {Event.System.EventID: 4624, User: "*<1>*"}}
"""
COUNT = RULE.replace("title: Logons", "title: Many").replace('filter: {condition: s, s: {Event.System.EventID: 4624, User: "*<1>*"}}', 'filter: {condition: s, s: {Event.System.EventID: 4624}}\naggregate: {count: ">=2", fields: [Event.System.Computer]}')
MAPPING = """
kind: evtx
rules: sigma
groups:
  - name: Sigma
    timestamp: Event.System.TimeCreated_attributes.SystemTime
    filter: {Event.System.EventID: 4624}
    fields: [{from: TargetUserName, to: Event.EventData.TargetUserName}]
"""
SIGMA = "title: S\nlevel: low\nstatus: stable\ndetection:\n  s: {TargetUserName|contains: '&2'}\n  condition: s\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    p = tmp_path_factory.mktemp("cli")
    (p / "logs").mkdir()
    (p / "logs" / "s.evtx").write_bytes(make.event_log(2, 3))
    for name, text in {"r.yml": RULE, "c.yml": COUNT, "m.yml": MAPPING, "s.yml": SIGMA, "bad.yml": "title: x\n"}.items():
        (p / name).write_text(text)
    (p / "patterns.txt").write_text("# comment\n\nuser<1>&[01]\n")
    return p


def lines(path):
    return [json.loads(x) for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_dump_and_search(spark, folder, tmp_path, capsys):
    assert cli.main(["dump", str(folder / "logs"), "--jsonl", "-o", str(tmp_path / "d")], spark) == 0
    assert len(lines(tmp_path / "d")) == 6
    assert cli.main(["dump", str(folder / "logs"), "--json", "-o", str(tmp_path / "a"), "--skip-errors"], spark) == 0
    (part,) = [f for f in (tmp_path / "a").glob("part-*")]
    assert [d["record_id"] for d in json.loads(part.read_text())] == [1, 2, 3, 4, 5, 6]
    assert cli.main(["search", str(folder / "logs"), "--regex-file", str(folder / "patterns.txt"), "--jsonl"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["search", str(folder / "logs"), "-t", "Event.System.EventID: =4624", "-t", "Event.EventData.TargetUserName: i*USER<0>*", "--jsonl"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert cli.main(["dump", str(folder / "none")], spark) == 1 and "[x]" in capsys.readouterr().err


def test_hunt(spark, folder, tmp_path):
    args = ["hunt", str(folder / "logs"), "-r", str(folder / "r.yml"), "-r", str(folder / "c.yml"), "-s", str(folder / "s.yml"), "-m", str(folder / "m.yml"), "--jsonl", "-o", str(tmp_path / "h")]
    assert cli.main(args, spark) == 0
    got = lines(tmp_path / "h")
    by = {n: [r for r in got if r["name"] == n] for n in ("Logons", "Many", "S")}
    assert [len(by[n]) for n in ("Logons", "Many", "S")] == [3, 6, 2]
    assert by["Logons"][0]["authors"] == ["ann"] and by["Logons"][0]["kind"] == "individual" and by["Logons"][0]["timestamp"] == "2020-01-01T00:00:00.000000Z"
    assert by["Many"][0]["kind"] == "aggregate" and by["Many"][0]["n_docs"] == 6 and by["Many"][0]["group_key"] == ["HOST-<1>"]
    assert by["S"][0]["group"] == "Sigma"


def test_lint(folder, capsys):
    assert cli.main(["lint", str(folder / "r.yml"), "-t"]) == 0
    assert "Event.System.EventID == 4624" in capsys.readouterr().out
    assert cli.main(["lint", str(folder / "bad.yml")]) == 1
    assert cli.main(["-q", "lint", str(folder / "s.yml"), "--engine", "sigma"]) == 0 and capsys.readouterr().err.count("[*]") == 1


def test_analyse(spark, tmp_path, capsys):
    from test_analyse import SOFTWARE, cache

    import struct

    system = {"Select": {"Current": (4, struct.pack("<I", 1))}, "ControlSet001": {"Control": {"Session Manager": {"AppCompatCache": {"AppCompatCache": (3, cache([("C:\\a.exe", make.TICKS)]))}}}}}
    (tmp_path / "SYSTEM").write_bytes(make.hive(system))
    (tmp_path / "SOFTWARE").write_bytes(make.hive(SOFTWARE))
    (tmp_path / "SRUDB.dat").write_bytes(make.ese_database([(11, "SruDbIdMapTable", [(1, "IdType", 2, 0)], [])]))
    assert cli.main(["shimcache", str(tmp_path / "SYSTEM"), "-e", "a\\.exe", "--csv", "-o", str(tmp_path / "t")], spark) == 0
    (part,) = [f.read_text() for f in (tmp_path / "t").glob("part-*") if f.stat().st_size]
    assert part.splitlines()[0] == "Timestamp,File Path,Program Name,SHA-1 Hash,Timeline Entry Number,Entry Type,Timestamp Description,Raw Entry" and "PatternMatch" in part and "ShimcacheLastUpdate" in part
    assert cli.main(["srum", str(tmp_path / "SRUDB.dat"), "--software", str(tmp_path / "SOFTWARE"), "--stats-only"], spark) == 0
    assert "App Resource (Long Term)" in capsys.readouterr().out
