import json
import struct

import builders as make
import pytest

from tracequarry.functions import forensic as fx
from tracequarry.sources import ese, evtx, files, hive, mft, sinks, store


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.JSON").write_text('{"y": 1}')
    (tmp_path / "c.jsonl").write_text('{"z": 1}\n\n{"z": 2}\nbroken\n{"z": 3}\n')
    (tmp_path / "d.xml").write_text('<Event><System><EventID>5</EventID></System><EventData><Data Name="U">u</Data><Data Name="K">1</Data><Data Name="K">2</Data><Data></Data></EventData><i a="1">t</i></Event>')
    (tmp_path / "e.xml").write_text("<open>")
    (tmp_path / "f.bin").write_bytes(file_table())
    (tmp_path / "g.txt").write_text("{}")
    return tmp_path


def record(number, parent, name, flags=1, data=b"abc"):
    info = struct.pack("<QQQQI", 132223104000000000, 132223104000000000, 0, 132223104000000000, 0x20) + b"\0" * 12
    label = name.encode("utf-16-le")
    file_name = struct.pack("<QQQQQQQII", parent, *[132223104000000000] * 4, 0, 3, 0x20, 0) + bytes([len(name), 1]) + label
    body = b""
    for kind, content in ((0x10, info), (0x30, file_name), (0x80, data)):
        size = (24 + len(content) + 7) // 8 * 8
        body += (struct.pack("<IIBBHHHIHH", kind, size, 0, 0, 0, 0, 0, len(content), 24, 0) + content).ljust(size, b"\0")
    head = struct.pack("<4sHHQHHHHIIQHHI", b"FILE", 0x30, 3, 0, 1, 1, 0x38, flags, 0x38 + len(body) + 4, 1024, 0, 0, 0, number)
    raw = bytearray((head + struct.pack("<HHH", 7, 0, 0) + b"\0\0" + body + b"\xff\xff\xff\xff").ljust(1024, b"\0"))
    raw[0x32:0x34], raw[0x34:0x36] = raw[510:512], raw[1022:1024]
    raw[510:512] = raw[1022:1024] = struct.pack("<H", 7)
    return bytes(raw)


def file_table():
    return record(5, 5, ".", 3) + record(40, 5, "dir", 3) + record(41, 40, "ünï.txt") + b"\0" * 1024 + b"FILE" + b"\1" * 1020


def test_file_table():
    got = list(mft.entries(file_table(), resident_data=True))
    assert [e["FullPath"] for e in got] == [".", "dir", "dir\\ünï.txt"] and got[2]["ResidentData"] == "616263" and got[2]["FileSize"] == 3
    assert got[1]["IsADirectory"] and got[2]["StandardInfoCreated"] == "2020-01-01T00:00:00Z" and got[2]["Flags"] == "ALLOCATED" and got[2]["FileNameFlags"] == "FILE_ATTRIBUTE_ARCHIVE"


def test_read(spark, folder):
    rows = files.read(spark, [str(folder)]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source.rpartition("/")[2], []).append(r)
    assert [(r.record_id, r.data) for r in by["a.json"]] == [(0, '{"x":1}'), (1, '{"x":2}')] and by["b.JSON"][0].record_id is None
    assert [(r.record_id, r.data) for r in by["c.jsonl"]] == [(1, '{"z":1}'), (3, '{"z":2}'), (4, None)] and "line 4" in by["c.jsonl"][2].error
    assert json.loads(by["d.xml"][0].data) == {"Event": {"System": {"EventID": "5"}, "EventData": {"U": "u", "K": ["1", "2"]}, "i": {"@a": "1", "$text": "t"}}}
    assert by["c.jsonl"][2].error.startswith("line 4: ") and by["e.xml"][0].data is None and by["g.txt"][0].error and len(by["f.bin"]) == 3
    assert all(r.error is None for r in files.read(spark, [str(folder)], skip_errors=True).collect())
    assert files.read(spark, [str(folder)], extensions=["txt"], load_unknown=True).first().data == "{}"
    assert files.read(spark, [str(folder)], extensions=["none"]).collect() == []
    with pytest.raises(FileNotFoundError):
        files.discover([str(folder / "absent")])


def test_json_lines_in_ranges(spark, tmp_path):
    lines = [json.dumps({"n": i, "t": "a\u2028b\u0085c" + "x" * (i % 50)}, ensure_ascii=False) if i % 7 else "" for i in range(1, 400)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "bad.jsonl").write_text("\n".join([*lines[:200], "{broken", *lines[200:]]), encoding="utf-8")
    want = [(i, json.loads(t)["n"]) for i, t in enumerate(lines, 1) if t]
    for split in (1 << 20, 1000, 37):
        rows = files.read(spark, [str(tmp_path)], split=split).collect()
        got = sorted((r.record_id, json.loads(r.data)["n"]) for r in rows if r.source.endswith("big.jsonl"))
        assert got == want, split
        bad = sorted((r.record_id, r.data is None, r.error) for r in rows if r.source.endswith("bad.jsonl"))
        assert [b[0] for b in bad] == [i for i, _ in want if i <= 200] + [201] and bad[-1][1] and bad[-1][2].startswith("line 201: ")


def test_json_arrays_are_streamed(tmp_path):
    good = ["[]", " [ ] ", "[1]", "[12, 3.5e2,true , null]", '[{"a": [1, {"b": "x]\\",["}]}, "é\u2028", [[]]]', "[" + ",".join(str(i) * 9 for i in range(1, 300)) + "]", '\ufeff[1]', "[123456789]"]
    bad = ["[1", "[1,]", "[1 2]", "[,]", "[1]]", "[1] 2", "[", "[NaN]", '["a]', "[01]", '{"a"', ""]
    for k, text in enumerate(good + bad):
        (tmp_path / "f").write_text(text, encoding="utf-8")
        for block in (1, 7, 1 << 20):
            with store.Source(str(tmp_path / "f")) as f:
                got = list(files.json_documents(f, block))
            if k < len(good):
                want = json.loads(text.lstrip("\ufeff"))
                assert [(i, json.loads(t), e) for i, t, e in got] == [(i, v, None) for i, v in enumerate(want)], (text, block)
            else:
                assert len(got) == 1 and got[0][1] is None and got[0][2], (text, block)


def test_file_table_in_ranges(spark, tmp_path):
    table = file_table() + b"".join(record(100 + i, 40 if i == 0 else 99 + i, f"d{i}", 3) for i in range(20))
    (tmp_path / "t.mft").write_bytes(table)
    whole = {r.record_id: json.loads(r.data) for r in files.read(spark, [str(tmp_path)]).collect()}
    cut = {r.record_id: json.loads(r.data) for r in files.read(spark, [str(tmp_path)], split=2048).collect()}
    assert whole == cut and whole[119]["FullPath"] == "dir\\" + "\\".join(f"d{i}" for i in range(20))


def test_file_table_of_large_records():
    big = b"".join(r.ljust(4096, b"\0")[:28] + struct.pack("<I", 4096) + r.ljust(4096, b"\0")[32:] for r in (record(5, 5, "."), record(40, 5, "dir")))
    assert [e["FullPath"] for e in mft.entries(big)] == [".", "dir"] and mft.record_size(big) == 4096


def test_event_log(spark, tmp_path):
    data = make.event_log(3, 4)
    (tmp_path / "s.evtx").write_bytes(data)
    (tmp_path / "x.evtx").write_bytes(b"nothing")
    for split in (1 << 30, 65_536):
        rows = sorted(files.read(spark, [str(tmp_path / "s.evtx")], split=split).collect(), key=lambda r: r.record_id)
        assert [r.record_id for r in rows] == list(range(1, 13)) and rows[0].timestamp == "2020-01-01T00:00:00.000001Z"
        assert json.loads(rows[0].data) == {
            "Event_attributes": {"xmlns": "http://x"},
            "Event": {
                "System": {
                    "Provider_attributes": {"Name": "Auditing", "Guid": "03020100-0504-0706-0809-0A0B0C0D0E0F"}, "EventID": 4624, "Version": 0,
                    "TimeCreated_attributes": {"SystemTime": "2020-01-01T00:00:00.000000Z"}, "Computer": "HOST-<1>", "Security_attributes": {"UserID": "S-1-5-32-544"},
                },
                "EventData": {"TargetUserName": "user<0>&0", "LogonType": 5, "IpPort": "0", "Data": "free"},
            },
        }
        assert json.loads(rows[1].data)["Event"]["System"]["Security"] is None
    assert files.read(spark, [str(tmp_path / "x.evtx")]).first().error == "not an event log"


def test_damaged_event_log_records():
    chunk = make.ChunkBuilder()
    make.logon(chunk, 1, "a")
    make.logon(chunk, 2, "b", damaged=True)
    make.logon(chunk, 3, "c")
    got = list(evtx.Chunk(chunk.done()).records())
    assert [(n, v is None) for n, _, v, _ in got] == [(1, False), (2, True), (3, False)]
    with pytest.raises(evtx.Damaged):
        evtx.Chunk(b"\0" * 65_536)


def test_event_values():
    assert evtx.value(0x81, make.utf16("a\0b\0")) == ["a", "b"] and evtx.value(0x88, struct.pack("<II", 1, 2)) == [1, 2]
    assert evtx.value(13, b"\1\0\0\0") is True and evtx.value(20, struct.pack("<I", 0x8020)) == "0x8020" and evtx.value(14, b"\xab") == "ab"
    assert evtx.value(18, struct.pack("<8H", 2020, 1, 3, 2, 3, 4, 5, 6)) == "2020-01-02T03:04:05.006Z"


HIVE = {
    "Software": {"Name": (1, make.sz("ünï")), "Path": (2, make.sz("%x%")), "N": (4, struct.pack("<I", 7)), "B": (5, struct.pack(">I", 9)), "Q": (11, struct.pack("<Q", 2**40)), "M": (7, make.sz("a") + make.sz("b") + b"\0\0"), "Raw": (3, b"\1\2\3"), "Empty": (0, b""), "Odd": (77, b"\xff"), "Inner": {}},
}


def test_hive(spark, tmp_path):
    (tmp_path / "a.hve").write_bytes(make.hive(HIVE))
    docs = [json.loads(r.data) for r in files.read(spark, [str(tmp_path)]).collect()]
    assert [(d["key_path"], d["subkeys"]) for d in docs] == [("ROOT", ["Software"]), ("Software", ["Inner"]), ("Software\\Inner", [])]
    assert docs[1]["last_modified"] == "2020-01-01T00:00:00Z" and {v["name"]: (v["type"], v["data"]) for v in docs[1]["values"]} == {
        "Name": ("REG_SZ", "ünï"), "Path": ("REG_EXPAND_SZ", "%x%"), "N": ("REG_DWORD", 7), "B": ("REG_DWORD_BIG_ENDIAN", 9), "Q": ("REG_QWORD", 2**40),
        "M": ("REG_MULTI_SZ", ["a", "b"]), "Raw": ("REG_BINARY", "010203"), "Empty": ("REG_NONE", None), "Odd": ("REG_BINARY", "ff"),
    }


def test_hive_lookups_lists_and_logs(tmp_path):
    b = make.HiveBuilder()
    deep = [b.key(f"k{i}", [("v", 4, struct.pack("<I", i))]) for i in range(3)]
    data = b.done(b.key("ROOT", (), [b.key("Ünder", (), deep, wide=True, lists=b"ri")]), (2, 1))
    h = hive.Hive(data)
    assert h.find("üNDER\\K2").value("v") == (4, struct.pack("<I", 2)) and h.find("ünder\\k2").value("V") is None and h.find("no\\such") is None
    at = deep[1]
    changed = bytearray(data[4096 + at : 4096 + at + 96])
    changed[80:82] = b"zz"  # the key's name
    (tmp_path / "x.hve").write_bytes(data)
    (tmp_path / "x.hve.LOG1").write_bytes(make.hive_log(1, [(at, bytes(changed))]))
    with store.Source(str(tmp_path / "x.hve")) as source:
        got = hive.open_hive(source, hive.logs_of(str(tmp_path / "x.hve")))
    assert [k.name for k in got.find("ünder").subkeys()] == ["k0", "zz", "k2"]
    with pytest.raises(hive.Damaged):
        hive.Hive(b"regf")
    broken = bytearray(data)
    broken[4096 + deep[0] + 4 : 4096 + deep[0] + 6] = b"??"
    assert [e for _, k, e in hive.Hive(bytes(broken)).walk() if k is None] == ["key under 'Ünder': not a key"]


def test_big_value():
    b = make.HiveBuilder()
    pieces = [b.cell(bytes([i]) * 16_344) for i in range(2)]
    listed = b.cell(b"".join(struct.pack("<I", p) for p in pieces))
    cell = b.cell(struct.pack("<2sHI", b"db", 2, listed))
    value = b.cell(struct.pack("<2sHIIIHH", b"vk", 1, 20_000, cell, 3, 1, 0) + b"x")
    root = b.cell(struct.pack("<2sHQIIIIIIIIII", b"nk", 0x20, make.TICKS, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, b.cell(struct.pack("<I", value)), 0, 0).ljust(72, b"\0") + struct.pack("<HH", 1, 0) + b"R")
    data = hive.Hive(b.done(root)).find("").value("x")[1]
    assert len(data) == 20_000 and data[0] == 0 and data[-1] == 1


def database():
    app = [(1, "AutoIncId", 4, 0), (2, "TimeStamp", 8, 0), (3, "AppId", 4, 0), (4, "UserId", 4, 0), (128, "Note", 10, 1252), (256, "Long", 12, 1200), (257, "Many", 4, 0), (258, "Apart", 11, 0)]
    ids = [(1, "IdType", 2, 0), (2, "IdIndex", 4, 0), (256, "IdBlob", 11, 0)]
    i4 = lambda n: struct.pack("<i", n)
    rows = [
        make.ese_record([i4(1), struct.pack("<d", 43831.5), i4(7), i4(9)], [b"note"], [(256, None, make.utf16("lang")), (257, 8, struct.pack("<HH", 4, 8) + i4(5) + i4(6)), (258, 4, struct.pack("<I", 1))]),
        make.ese_record([i4(2), struct.pack("<d", 0.0), i4(0), i4(0)], [], nulls=b"\x0e"),
    ]
    blobs = [make.ese_record([b"\1", i4(7)], [], [(256, None, make.utf16("c:\\app.exe"))]), make.ese_record([b"\3", i4(9)], [], [(256, None, bytes([1, 2, 0, 0, 0, 0, 0, 5]) + struct.pack("<II", 32, 544))])]
    return make.ese_database([(10, "{D10C}", app, rows), (11, "SruDbIdMapTable", ids, blobs)], [(10, [(struct.pack(">II", 1, 0), b"ab"), (struct.pack(">II", 1, 2), b"cd")])])


def test_database(spark, tmp_path):
    (tmp_path / "SRUDB.dat").write_bytes(database())
    got = [json.loads(r.data) for r in files.read(spark, [str(tmp_path)]).collect()]
    assert got[0] == {"AutoIncId": 1, "TimeStamp": "2020-01-01T12:00:00Z", "AppId": 7, "UserId": 9, "Note": "note", "Long": "lang", "Many": [5, 6], "Apart": "61626364", "Table": "{D10C}"}
    assert got[1] == {"AutoIncId": 2, "Table": "{D10C}"} and got[2]["IdBlob"] == make.utf16("c:\\app.exe").hex() and len(got) == 4
    packed = bytes([0x08]) + sum(b << (7 * i) for i, b in enumerate(b"seven bits")).to_bytes(9, "little")
    assert ese.decompressed(packed) == b"seven bits"
    (tmp_path / "bad.edb").write_bytes(b"x" * 500)
    assert files.read(spark, [str(tmp_path / "bad.edb")]).first().error == "not an ESE database"


def test_unknown_files_are_sniffed(spark, tmp_path):
    for name, data in {"a.x": make.event_log(1, 1), "b.x": make.hive({}), "c.x": database(), "d.x": file_table(), "e.x": b"[1, 2]", "f.x": b"<a/>", "g.x": b"\xff\xfe"}.items():
        (tmp_path / name).write_bytes(data)
    kinds = {}
    for r in files.read(spark, [str(tmp_path)], load_unknown=True).collect():
        kinds.setdefault(r.source[-3:], set()).add((r.kind, r.error is None))
    assert kinds == {"a.x": {("evtx", True)}, "b.x": {("hve", True)}, "c.x": {("esedb", True)}, "d.x": {("mft", True)}, "e.x": {("json", True)}, "f.x": {("xml", True)}, "g.x": {("unknown", False)}}


def test_store(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text("1")
    (tmp_path / "$MFT").write_text("2")
    uri = "file://" + str(tmp_path)
    assert [p for p, _ in store.discover_sized([str(tmp_path)])] == [str(tmp_path / "$MFT"), str(tmp_path / "a" / "x.json")]
    assert [p.rpartition("/")[2] for p, _ in store.discover_sized([uri], ["json"])] == ["x.json"] and len(store.discover_sized([uri], ["$MFT"])) == 1
    with store.Source(store.discover_sized([uri], ["json"])[0][0]) as f:
        assert f.read(0, 9) == b"1"
    (tmp_path / "b c").mkdir()
    (tmp_path / "b c" / "é.json").write_text("3")
    for p in (str(tmp_path / "b c"), uri + "/b c", uri + "/b%20c", "file:" + str(tmp_path / "b c")):
        ((found, size),) = store.discover_sized([p])
        with store.Source(found) as f:
            assert f.read(0, 9) == b"3" and size == 1
    assert store.discover_sized([str(tmp_path / "no")], skip_errors=True) == []


def test_entities_are_refused():
    assert files.xml_document(b'<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>')[2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\n b"), (2, None)], "i int, s string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"i":1,"s":"a\\n b"}', '{"i":2}']
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True).count() == 2
    assert "| 1 | a b |" in sinks.table_text(df)


def test_more_sinks(spark, tmp_path):
    hits = spark.createDataFrame([("g", "r", "high", "stable", "2024-01-01T00:00:00Z", "x" * 60 + "\n", "s")], "hunt string, rule string, level string, status string, hit_ts string, text string, source string")
    shown = sinks.hunt_table(sinks.cached(hits), "hit_ts", ["text"]).first()
    assert (shown.timestamp, shown.detections, len(shown.text)) == ("2024-01-01T00:00:00Z", "g: r", 40)
    sinks.write_yaml(hits.select("rule"), str(tmp_path / "y"))
    assert "".join(f.read_text() for f in (tmp_path / "y").glob("part-*")).startswith('---\n{')
    sinks.write_log(hits, str(tmp_path / "l"))
    assert "".join(f.read_text() for f in (tmp_path / "l").glob("part-*")) == "2024-01-01T00:00:00Z\tg\tr\ts\n"
    for rows in ([], [1], [3, 1, 2]):
        sinks.write_json_array(spark.createDataFrame([(i,) for i in rows], "i int"), str(tmp_path / "a"), ["i"])
        assert json.loads("".join(f.read_text() for f in (tmp_path / "a").glob("part-*"))) == [{"i": i} for i in sorted(rows)]


def test_sizes(spark, folder):
    got = {r.kind: (r.n_files, r.size) for r in files.sizes(spark, [str(folder)]).collect()}
    assert got["json"][0] == 2 and got["mft"] == (1, "5.00 KB") and got["unknown"][0] == 1


def test_record_keys_are_the_same_every_time(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", None), ("a1", None)], "s string, r bigint")
    got = [r[0] for r in df.select(fx.record_key(df.s, df.r)).collect()]
    assert got[0] == got[1] and len(set(got)) == 4


def test_functions(spark):
    df = spark.createDataFrame([(132223104000000001, 43831.5, 1.5, "0001000200030004", 34404, 0x21, "0000" + "a" * 40, "\\??\\SYSVOL\\x\\y.exe", bytes.fromhex("010200000000000520000000200200" + "00"))],
                               "ft bigint, ole double, days double, ver string, m int, bits int, fid string, path string, sid binary")
    c = lambda f, n: f(df[n])
    row = df.select(
        c(fx.filetime_micros, "ft"), c(fx.filetime_seconds, "ft"), c(fx.ole_date, "ole"), c(fx.format_duration, "days"), c(fx.hex_version, "ver"), c(fx.architecture, "m"),
        c(fx.flag_names, "bits"), c(fx.sha1_of_file_id, "fid"), c(fx.clean_path, "path"), c(fx.last_path_part, "path"), c(fx.sid_text, "sid"),
    ).first()
    assert list(row) == [
        "2020-01-01T00:00:00.000000Z", "2020-01-01T00:00:00Z", "2020-01-01T12:00:00Z", "1 days, 12 hours", "1.2.3.4", "AMD64",
        "FILE_ATTRIBUTE_READONLY | FILE_ATTRIBUTE_ARCHIVE", "a" * 40, "C:\\x\\y.exe", "y.exe", "S-1-5-32-544",
    ]
