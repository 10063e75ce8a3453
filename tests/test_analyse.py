"""Program caches, inventories, timelines and resource usage from synthesised hives and databases."""

import json
import struct

import builders as make
import pytest

from tracequarry.analyse import timeline as tl
from tracequarry.analyse import usage
from tracequarry.sources import files
from tracequarry.sources import program_cache as pc

MINUTE = 60 * 10**7
HOUR = 60 * MINUTE
PROGRAM = "00000000 0001000200030004 000A000000000000 8664 Contoso.App pub123 neutral"


def cache(entries):
    return make.cache10([(p, t, b"xx") for p, t in entries])


def test_decoders():
    rows = [("C:\\a.exe", make.TICKS, True), ("SYSVOL\\b.exe", make.TICKS + HOUR, False)]
    assert pc.decode(make.cache7(rows)) == ("Windows 7 64-bit or Windows Server 2008 R2", [("C:\\a.exe", True, make.TICKS, 16, None), ("SYSVOL\\b.exe", False, make.TICKS + HOUR, 24, None)])
    assert pc.decode(make.cache7([("\\??\\C:\\x", 5, False)], wide=False), narrow=True) == ("Windows 7 32-bit", [("C:\\x", False, 5, 16, None)])
    for sign, name in ((b"00ts", "Windows 8 or Windows Server 2012"), (b"10ts", "Windows 8.1 or Windows 2012 R2")):
        version, got = pc.decode(make.cache8(rows, sign))
        assert version == name and [(g[0], g[1]) for g in got] == [("C:\\a.exe", True), ("C:\\b.exe", False)]
    assert pc.decode(cache([("C:\\ü.exe", 7)])) == ("Windows 10 Creators", [("C:\\ü.exe", None, 7, 16, "10ts")])
    assert pc.decode(make.cache10([("C:\\a", 7, b"")], header=0x30))[0] == "Windows 10"
    shifted = struct.pack("<I", 9) + b"\0" * 150 + make.cache10([("C:\\a", 7, b"")])[0x34:]
    assert pc.decode(shifted)[1][0][0] == "C:\\a"
    for bad in (b"", struct.pack("<I", 0xDEADBEEF), struct.pack("<I", 0xBADC0FFE), b"\0" * 200):
        with pytest.raises(pc.Unsupported):
            pc.decode(bad)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    p = tmp_path_factory.mktemp("hives")
    t = make.TICKS
    entries = [("C:\\New.exe", t), (PROGRAM, 0), ("C:\\Tools\\Anchor.exe", t - 2 * HOUR), ("C:\\mid.exe", t - 9 * HOUR), ("C:\\pair.exe", t - 3 * HOUR), ("C:\\Tools\\anchor.exe", t - 5 * HOUR), ("C:\\old.exe", t)]
    system = {"Select": {"Current": (4, struct.pack("<I", 1))}, "ControlSet001": {"Control": {"Session Manager": {"AppCompatCache": {"AppCompatCache": (3, cache(entries))}}}}}
    (p / "SYSTEM.hve").write_bytes(make.hive(system))
    inventory = {"Root": {
        "InventoryApplicationFile": {"pair|1": {"LowerCaseLongPath": (1, make.sz("c:\\pair.exe")), "FileId": (1, make.sz("0000" + "a" * 40)), "ProgramId": (1, make.sz("p1"))}},
        "InventoryApplication": {"p9": {"Name": (1, make.sz("Contoso.App")), "Version": (1, make.sz("1.2.3.4")), "RootDirPath": (1, make.sz("C:\\c"))}},
        "Programs": {"ignored": {"0": (1, make.sz("x"))}},
    }}
    (p / "AM.hve").write_bytes(make.hive(inventory))
    (p / "OLD.hve").write_bytes(make.hive({"Root": {"Programs": {"q1": {"0": (1, make.sz("Old")), "1": (1, make.sz("2"))}}, "File": {"vol": {"f1": {"15": (1, make.sz("c:\\o")), "101": (1, make.sz("z")), "100": (1, make.sz("q1"))}}}}}))
    (p / "BAD.hve").write_bytes(make.hive({"Select": {"Current": (4, struct.pack("<I", 1))}, "ControlSet001": {"Control": {"Session Manager": {"AppCompatCache": {"AppCompatCache": (3, b"\0" * 200)}}}}}))
    return p


def test_cache_and_inventory(spark, folder):
    keys = pc.hive_keys(files.read(spark, [str(folder)])).cache()
    rows = pc.cache_entries(keys).orderBy("source", "position").collect()
    good = [r for r in rows if r.error is None]
    assert [r.path for r in good] == ["C:\\New.exe", None, "C:\\Tools\\Anchor.exe", "C:\\mid.exe", "C:\\pair.exe", "C:\\Tools\\anchor.exe", "C:\\old.exe"]
    assert (good[1].program_name, good[1].program_version, good[1].architecture, good[1].neutral, good[1].last_modified_ts) == ("Contoso.App", "1.2.3.4", "AMD64", True, None)
    assert len(rows) == 8 and {r.source[-7:] for r in rows if r.error} == {"BAD.hve"} and str(good[0].last_update_ts) == "2020-01-01 00:00:00"
    got = {(r.source[-7:], r.path, r.sha1, r.program_id) for r in pc.inventory_files(keys).collect()}
    assert got == {("/AM.hve", "c:\\pair.exe", "a" * 40, "p1"), ("OLD.hve", "c:\\o", None, "q1")}
    got = {(r.program_id, r.program_name, r.version, r.root_directory) for r in pc.inventory_programs(keys).collect()}
    assert got == {("p9", "Contoso.App", "1.2.3.4", "C:\\c"), ("q1", "Old", "2", None)}
    assert pc.keys_at(keys, "select").count() == 2


def test_whole_timeline(spark, folder):
    keys = pc.hive_keys(files.read(spark, [str(folder)])).cache()
    entries = pc.cache_entries(keys).where("error IS NULL").cache()
    inventory = pc.inventory_files(keys).select(tl.F.col("path").alias("file_path"), "sha1", tl.F.expr("TIMESTAMP '2019-12-31 20:00:00'").alias("file_ts"))
    out = tl.timeline(
        entries, ["anchor\\.exe$"], inventory, True, modified="last_modified_ts", programs=pc.inventory_programs(keys).select("program_name", "version", "program_id", "program_ts"),
        updates=entries.select("source", "last_update_ts"),
    )
    rows = tl.timeline_columns(out.orderBy("position")).collect()
    at = lambda h: f"2019-12-31T{h:02}:00:00.000000Z"
    assert [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows] == [
        ("2020-01-01T00:00:00.000000Z", None, None, None, 1, "ShimcacheLastUpdate", "ShimcacheLastUpdate"),
        (at(22), "C:\\New.exe", None, None, 2, "File", "Range"), (at(22), None, "Contoso.App", None, 3, "Program", "Range"),
        (at(22), "C:\\Tools\\Anchor.exe", None, None, 4, "File", "PatternMatch"), (at(20), "C:\\mid.exe", None, None, 5, "File", "Range"),
        (at(20), "C:\\pair.exe", None, "a" * 40, 6, "File", "AmcacheRangeMatch"), (at(19), "C:\\Tools\\anchor.exe", None, None, 7, "File", "PatternMatch"),
        (at(19), "C:\\old.exe", None, None, 8, "File", "RangeEnd"),
    ]
    assert out.where("program_name IS NOT NULL").first().program_id == "p9" and rows[2][7] == PROGRAM
    near = tl.timeline(entries, ["anchor\\.exe$"], inventory.withColumn("file_ts", tl.F.expr("TIMESTAMP '2019-12-31 21:00:30'")), True, modified="last_modified_ts")
    assert near.where("path = 'C:\\\\pair.exe'").first().how == "NearTSMatch"


def test_near_pairs_against_brute_force(spark):
    import random

    random.seed(3)
    a = [(i, random.choice("xyz"), random.randint(0, 4000)) for i in range(120)]
    b = [(i, random.choice("xyz"), random.randint(0, 4000)) for i in range(120)]
    left = spark.createDataFrame(a, "i int, k string, s int").selectExpr("i", "k", "timestamp_seconds(s) AS t")
    right = spark.createDataFrame(b, "j int, k string, s int").selectExpr("j", "k", "timestamp_seconds(s) AS u")
    got = sorted((r.i, r.j) for r in tl.near_pairs(left, right, "k", "t", "u", 60).collect())
    assert got == sorted((i, j) for i, k, t in a for j, m, u in b if k == m and abs(t - u) <= 60)


SOFTWARE = {"Microsoft": {"Windows NT": {"CurrentVersion": {
    "SRUM": {
        "Parameters": {"Tier2Period": (4, struct.pack("<I", 7200))},
        "Extensions": {
            "{d10c}": {"": (1, make.sz("App Resource")), "DllName": (1, make.sz("a.dll")), "LastLongTermUpdate": (11, struct.pack("<Q", 1)), "Tier2MaxEntries": (4, struct.pack("<I", 720))},
            "{EEEE}": {"": (1, make.sz("Energy")), "Tier2Period": (4, struct.pack("<I", 3600))},
        },
    },
    "ProfileList": {"S-1-5-32-544": {"Sid": (3, b"\1\2"), "ProfileImagePath": (2, make.sz("C:\\Users\\ann"))}},
}}}}


def test_usage_from_files(spark, tmp_path):
    i4 = lambda n: struct.pack("<i", n)
    columns = [(1, "TimeStamp", 8, 0), (2, "AppId", 4, 0), (3, "UserId", 4, 0), (4, "EndTime", 15, 0)]
    ids = [(1, "IdType", 2, 0), (2, "IdIndex", 4, 0), (256, "IdBlob", 11, 0)]
    rows = [make.ese_record([struct.pack("<d", 43831.5 + d), i4(7), i4(9), struct.pack("<q", make.TICKS)]) for d in range(3)]
    blobs = [make.ese_record([b"\1", i4(7)], [], [(256, None, make.utf16(t))]) for t in ("zzz", "app")]
    blobs.append(make.ese_record([b"\3", i4(9)], [], [(256, None, bytes([1, 2, 0, 0, 0, 0, 0, 5]) + struct.pack("<II", 32, 544))]))
    (tmp_path / "SRUDB.dat").write_bytes(make.ese_database([(10, "{D10C}LT", columns, rows), (11, "SruDbIdMapTable", ids, blobs)]))
    (tmp_path / "SOFTWARE.hve").write_bytes(make.hive(SOFTWARE))
    docs = files.read(spark, [str(tmp_path)]).cache()
    keys = pc.hive_keys(docs)
    got = usage.usage_records(docs, pc.users(keys), pc.usage_extensions(keys)).orderBy("record_id").collect()
    assert [(r.timestamp, r.app_name, r.user_sid, r.user_name, r.table_name, r.EndTime) for r in got][:1] == [("2020-01-01T12:00:00Z", "app", "S-1-5-32-544", "ann", "App Resource (Long Term)", "2020-01-01T00:00:00Z")]
    assert len(got) == 3 and json.loads(got[0].data)["AppId"] == 7
    tables = usage.retained_tables(pc.usage_extensions(keys), pc.usage_parameters(keys))
    shown = usage.details(usage.time_frames(usage.usage_records(docs)), tables).collect()
    assert [(r.guid, r.table_name, r.dll_path, r.retention, r.first_seen, r.last_seen) for r in shown] == [
        ("{D10C}", "App Resource", "a.dll", "60 days", None, None), ("{D10C}LT", "App Resource (Long Term)", "a.dll", "1820 days", "2020-01-01T12:00:00Z", "2020-01-03T12:00:00Z"),
        ("{EEEE}", "Energy", None, "60 days", None, None),
    ]
