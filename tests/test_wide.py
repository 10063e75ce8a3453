from datetime import datetime

from tracequarry.operators.wide import Attribute, attributes_to_wide, wide_cells

ATTRS = [Attribute("Size", "int"), Attribute("LinkDate", "datetime"), Attribute("Deps", "list"), Attribute("Code", "bytes"), Attribute("Name", "text")]
SCHEMA = "key_id bigint, value_name string, value_type string, value_data string, collected_at timestamp, row_id bigint, attr string, cell string"
T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def cells(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return {(r.key_id, r.attr): r.cell for r in wide_cells(attributes_to_wide(df, ATTRS), ATTRS).collect()}


def test_notations(spark):
    rows = []
    ints = {"7": "7", " 42 ": "42", "1,234,567": "1234567", "0x0000001f": "31", "dword:0000000a": "10", "0x1F (31)": "31", "hex(b):07,01,00,00,00,00,00,00": "263", "00272": "272"}
    for i, v in enumerate(ints):
        rows.append((i, "size\x00", "Dword", v, T1, i))
    dates = {"10/26/2020 17:00:33": "2020-10-26T17:00:33", "2020-02-25T05:21:12": "2020-02-25T05:21:12", "20250210111806": "2025-02-10T11:18:06", " 1/2/2021 3:04:05": "2021-01-02T03:04:05"}
    for i, v in enumerate(dates):
        rows.append((100 + i, '"LINKDATE"', "String", v, T1, 100 + i))
    lists = {'["a", "b"]': "a|b", "a\x00b\x00\x00": "a|b", "a\n\nb": "a|b", "hex(7):61,00,00,00,62,00,00,00,00,00": "a|b"}
    for i, v in enumerate(lists):
        rows.append((200 + i, " deps", "MultiString", v, T1, 200 + i))
    codes = {"AA BB": "aabb", "hex:aa,bb": "aabb", "0xAABB": "aabb", "aa-bb": "aabb"}
    for i, v in enumerate(codes):
        rows.append((300 + i, "Code", "Binary", v, T1, 300 + i))
    got = cells(spark, rows)
    assert [got[i, "Size"] for i in range(len(ints))] == list(ints.values())
    assert [got[100 + i, "LinkDate"] for i in range(len(dates))] == list(dates.values())
    assert [got[200 + i, "Deps"] for i in range(len(lists))] == list(lists.values())
    assert [got[300 + i, "Code"] for i in range(len(codes))] == list(codes.values())


def test_latest_usable_value_wins(spark):
    rows = [
        (1, "Name", "String", "old", T1, 1), (1, "Name", "String", "new", T2, 2), (1, "Name", "String", "newer row", T2, 3), (1, "Name", "String", "newer row", T2, 3),
        (1, "Name", "Error", "x", T2, 9), (1, "Name", "String", "(value not set)", T2, 10), (1, "Name", "String", None, T2, 11), (1, "Size", "String", "many", T2, 12),
        (2, "Name", "String", "no time", None, 5), (2, "Name", None, "timed", T1, 4), (None, "Name", "String", "x", T1, 6), (3, None, "String", "x", T1, 7), (4, "Other", "String", "x", T1, 8),
        (5, "LinkDate", "String", "13/13/2020 00:00:00", T1, 13), (5, "LinkDate", "String", "02/30/2020 00:00:00", T1, 14),
    ]
    assert cells(spark, rows) == {(1, "Name"): "newer row", (2, "Name"): "timed"}


def test_empty_long_and_many(spark):
    assert cells(spark, []) == {}
    long = "x" * 200_000
    rows = [(i, a, "String", "5" if a == "Size" else long if i == 7 else f"n{i}", T1, i) for i in range(3000) for a in ("Size", "Name")]
    got = cells(spark, rows)
    assert len(got) == 6000 and got[7, "Name"] == long and got[2999, "Size"] == "5"


def test_batches_cut_between_entities(spark):
    from tracequarry.operators.wide import latest_values, to_wide

    df = spark.createDataFrame([(i // 2, "Size" if i % 2 else "Name", "String", str(i), T1, i, "", "") for i in range(400)], SCHEMA)
    wide = to_wide(latest_values(df, ATTRS), ATTRS, batch=7).collect()
    assert len(wide) == 200 and all(r.Size == 2 * r.key_id + 1 and r.Name == str(2 * r.key_id) for r in wide)
