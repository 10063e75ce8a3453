from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracequarry.operators.instants import ZoneTables, normalise_instants, to_micros, utc_text, zone_tables

HOSTS = [("a", "Europe/Berlin", "de-DE"), ("u", "America/New_York", "en-US"), ("l", "Australia/Lord_Howe", "en-AU"), ("x", "No/Where", "en-GB"), (None, "UTC", "en-GB")]


def run(spark, rows):
    df = spark.createDataFrame(rows, "i int, computer string, t string, time_zone string")
    hosts = spark.createDataFrame(HOSTS, "computer string, time_zone string, locale_tag string")
    out = normalise_instants(df, hosts, "t")
    return {r[0]: r[1] for r in out.select("i", utc_text(F.col("utc"))).collect()}


def test_forms(spark):
    cases = [
        ("a", "2020-06-05 06:33:48", "2020-06-05T04:33:48.000000Z"), ("a", "19.07.2024 20:20:08", "2024-07-19T18:20:08.000000Z"), ("u", "7/01/2020 2:59:09 AM", "2020-07-01T06:59:09.000000Z"),
        ("l", "7/01/2020 2:59:09 AM", "2020-01-06T15:59:09.000000Z"), ("a", "2020-01-07T03:30:06.863362+05:45", "2020-01-06T21:45:06.863362Z"), ("a", "2020-01-07t03:33:05.617142z", "2020-01-07T03:33:05.617142Z"),
        ("a", "2020-01-07T14:55:39.668611758Z", "2020-01-07T14:55:39.668611Z"), ("a", "1578311788", "2020-01-06T11:56:28.000000Z"), ("a", "1578469212197", "2020-01-08T07:40:12.197000Z"),
        ("a", "132228448232097883", "2020-01-07T04:27:03.209788Z"), ("a", "0x01D5D20527194461", None), ("a", "20200108091734.547794+330", "2020-01-08T03:47:34.547794Z"),
        ("a", "[11/Jan/2020:01:06:28 +0100]", "2020-01-11T00:06:28.000000Z"), ("a", "Mon, 06 Jan 2020 12:10:39 -0230", "2020-01-06T14:40:39.000000Z"), ("a", "12 Jan 2020 13:47:15 CET", "2020-01-12T12:47:15.000000Z"),
        ("a", "20200106T183936Z", "2020-01-06T18:39:36.000000Z"), ("u", "2020-02-07 12:32:15 AM", "2020-02-07T05:32:15.000000Z"),
        ("a", "29.03.2020 02:30:00", None), ("a", "25.10.2020 02:30:00", "2020-10-25T00:30:00.000000Z"), ("l", "05/04/2020 1:45:00 AM", "2020-04-04T14:45:00.000000Z"),
        ("a", "2023-02-30 11:20:00", None), ("a", "25:61:00", None), ("a", "", None), ("a", None, None), ("a", "never", None), ("a", "x" * 100_000, None), ("x", "2020-06-05 06:33:48", None),
        ("nobody", "2020-06-05 06:33:48", None), (None, "2020-06-05 06:33:48", None), ("nobody", "2020-06-05 06:33:48 UTC", "2020-06-05T06:33:48.000000Z"), ("a", "1999-06-05 06:33:48", None),
        ("a", "0", None), ("a", "9223372036854775807", None), ("a", "99999999999999999999", None),
    ]
    got = run(spark, [(i, c, t, "zz") for i, (c, t, _) in enumerate(cases)])
    for i, (_, t, want) in enumerate(cases):
        if t != "0x01D5D20527194461":
            assert got[i] == want, (t[:40] if t else t, got[i], want)
    assert got[10].startswith("2020-01-2")


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_zone_tables_name_their_version(spark):
    tables = zone_tables(spark, ["Europe/Berlin", "Asia/Tokyo", "No/Where"])
    assert tables.version and len(tables.starts["Asia/Tokyo"]) == 1 and len(tables.starts["Europe/Berlin"]) > 15 and "No/Where" not in tables.starts


def _berlin() -> ZoneTables:
    zone, starts, offsets = ZoneInfo("Europe/Berlin"), [-(2**62)], [3600]
    t = datetime(2018, 6, 1, tzinfo=UTC)
    last = int(t.astimezone(zone).utcoffset().total_seconds())
    offsets[0] = last
    while t.year < 2028:
        t += timedelta(hours=1)
        now = int(t.astimezone(zone).utcoffset().total_seconds())
        if now != last:
            starts.append(int(t.timestamp()))
            offsets.append(now)
            last = now
    return ZoneTables("test", {"Europe/Berlin": starts}, {"Europe/Berlin": offsets})


BERLIN = _berlin()


@settings(max_examples=200, deadline=None)
@given(st.datetimes(min_value=datetime(2019, 2, 1), max_value=datetime(2026, 11, 30)))
def test_local_times_against_zoneinfo(local):
    local = local.replace(microsecond=0)
    zone = ZoneInfo("Europe/Berlin")
    utc = local.replace(tzinfo=zone, fold=0).astimezone(UTC)
    real = utc.astimezone(zone).replace(tzinfo=None) == local
    micros, found = to_micros([local.strftime("%d.%m.%Y %H:%M:%S")], ["Europe/Berlin"], ["de-DE"], BERLIN)
    assert bool(found[0]) == real
    if real:
        assert int(micros[0]) == int(utc.timestamp()) * 10**6


def test_masks_are_shared():
    n = 5000
    texts = [f"2021-05-{1 + i % 28:02d} 10:{i % 60:02d}:00" for i in range(n)]
    micros, found = to_micros(texts, ["Europe/Berlin"] * n, [None] * n, BERLIN)
    assert found.all() and len(np.unique(micros)) > 100


def test_filetimes_of_all_rows_are_converted(spark, data):
    from tracequarry.plans import catalogue
    from tracequarry.runtime import table

    got = catalogue.queries()["filetime_text"](spark, data)
    assert got.count() == table(spark, data, "mft_entries").count()
    outside = got.join(table(spark, data, "mft_entries").where("file_name_created_ft <= 0"), "row_id")
    assert outside.where("created IS NOT NULL").count() == 0


def test_many_zone_texts_and_blanks(spark):
    hosts = [(f"h{i}", "Asia/Tokyo" if i == 1499 else "UTC+05:30" if i == 1498 else f"Not/AZone{i}", "en-GB") for i in range(1500)]
    hosts = spark.createDataFrame(hosts, "computer string, time_zone string, locale_tag string")
    rows = [(1, "h1499", "2020-06-05 06:33:48"), (2, "h1498", "2020-06-05 06:33:48"), (3, "h7", "2020-06-05 06:33:48"), (4, "h7", " " * 500 + "2020-06-05T06:33:48Z" + "\0" * 9)]
    out = normalise_instants(spark.createDataFrame(rows, "i int, computer string, t string"), hosts, "t", rules="tz_version")
    got = {r[0]: r[1] for r in out.select("i", utc_text(F.col("utc"))).collect()}
    assert got == {1: "2020-06-04T21:33:48.000000Z", 2: "2020-06-05T01:03:48.000000Z", 3: None, 4: "2020-06-05T06:33:48.000000Z"}
    assert {r[0] for r in out.select("tz_version").collect()} == {zone_tables(spark, []).version}


def test_other_years(spark):
    rows = spark.createDataFrame([("a", "1999-06-05 06:33:48"), ("a", "2020-06-05 06:33:48")], "computer string, t string")
    out = normalise_instants(rows, spark.createDataFrame(HOSTS, "computer string, time_zone string, locale_tag string"), "t", years=(1990, 2005))
    assert [r[0] for r in out.select(utc_text(F.col("utc"))).collect()] == ["1999-06-05T04:33:48.000000Z", None]
