import datetime as dt

import pytest
from pyspark.sql import functions as F

from loupe.functions import keys, text
from loupe.operators.current import current_photos


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, map(kind, values.values())))) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def kind(v):
    return {bool: "boolean", int: "long", float: "double", str: "string", dt.datetime: "timestamp_ntz"}[type(v)]


@pytest.mark.parametrize("a,b,d", [(5, 5, 0), (0, -1, 64), (1, 2, 2), (-1, -2, 1)])
def test_hamming(spark, a, b, d):
    assert one(spark, keys.hamming("a", "b"), a=a, b=b) == d


@pytest.mark.parametrize("s,ok", [("a" * 64, True), (" \t" + "AB" * 32 + "\u00a0\n", True), ("a" * 63, False), ("g" * 64, False), ("", False), ("a" * 32 + " " + "a" * 31, False)])
def test_sha_key(spark, s, ok):
    got = one(spark, keys.sha_key("s"), s=s)
    assert (got is not None) == ok and (not ok or bytes(got).hex() == s.strip().lower())


def test_micros_ignores_the_session_zone(spark):
    t = dt.datetime(2021, 3, 28, 2, 30, 0, 123456)  # does not exist in many zones
    want = int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "Europe/Berlin", "America/St_Johns"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert one(spark, keys.micros("t"), t=t) == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
    assert one(spark, keys.micros("t"), t=dt.datetime(1969, 12, 31, 23, 59, 59, 999999)) == -1


def test_path_key_and_area(spark):
    assert one(spark, keys.path_key("p"), p="c:/a\\_b.jpg") == "C:\\A\\_B.JPG"
    assert one(spark, keys.area("w", "h"), w=100_000, h=70_000) == 7_000_000_000
    assert one(spark, keys.area("w", "h"), w=-1, h=-1) == 0


@pytest.mark.parametrize("path,fmt,ext,name,stem,dir_", [
    ("C:\\a.b\\c.JPEG", "Jpeg", ".jpeg", "c.JPEG", "c", "C:\\a.b"), ("/x/y.heif", "Heic", ".heif", "y.heif", "y", "/x"), ("noext", None, "", "noext", "noext", ""),
    ("/x/.png", "Png", ".png", ".png", "", "/x"), ("/a.d/file", None, "", "file", "file", "/a.d"), ("m.tar.Png", "Png", ".png", "m.tar.Png", "m.tar", ""),
])
def test_paths(spark, path, fmt, ext, name, stem, dir_):
    row = spark.createDataFrame([(path,)], "p string").select(
        text.supported_format("p"), text.extension("p"), text.file_name("p"), text.stem("p"), text.folder("p")).first()
    assert tuple(row) == (fmt, ext, name, stem, dir_)


@pytest.mark.parametrize("path,inside", [
    ("/a/potentialduplicates/b.jpg", True), ("C:\\PotentialDuplicates\\x\\y.jpg", True), ("/a/PotentialDuplicates", False), ("/a/PotentialDuplicates2/b", False),
])
def test_set_aside(spark, path, inside):
    assert one(spark, text.set_aside("p"), p=path) is inside


@pytest.mark.parametrize("s,shown,clock", [(0, "0s", "0:00:00"), (59.9, "59s", "0:00:59"), (60, "1m 0s", "0:01:00"), (3661, "1h 1m 1s", "1:01:01"), (90000, "25h 0m 0s", "25:00:00")])
def test_durations(spark, s, shown, clock):
    assert one(spark, text.duration_text("s"), s=float(s)) == shown and one(spark, text.clock_text("s"), s=float(s)) == clock


def test_numbers_and_names(spark):
    assert [one(spark, text.snapped("v", 1.0, 20.0, 0.5), v=v) for v in (0.2, 1.25, 1.75, 3.3, 99.0)] == [1.0, 1.0, 2.0, 3.5, 20.0]
    assert one(spark, text.percent("v"), v=0.125) == 12
    assert one(spark, text.safe_file_name("s"), s='  a<b>:c"/\\|?*\t.jpg ') == "abc.jpg"
    assert one(spark, text.spaced("s"), s="HasVisualComponent") == "Has Visual Component"
    assert one(spark, text.from_hex16("s"), s="ffffffffffffffff") == -1
    assert one(spark, text.hex16("v"), v=-2) == "fffffffffffffffe" and one(spark, text.hex16("v"), v=255) == "00000000000000ff"


def test_first_match_takes_the_first_rule(spark):
    rules = [("a", ("Disk Full", "no space")), ("b", ("denied",))]
    assert one(spark, text.first_match("s", rules, "other"), s="access DENIED, disk full") == "a"
    assert one(spark, text.first_match("s", rules, "other"), s="Denied") == "b"
    assert one(spark, text.first_match("s", rules, "other"), s="") == "other"


def test_current_rows(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [(1, "old", t), (1, "new", t + dt.timedelta(1)), (1, "none", None), (2, "x", None), (None, "y", t), (3, "z", t), (3, "z", t)]
    got = current_photos(spark.createDataFrame(rows, "seq long, v string, loaded_at timestamp_ntz"), "v", F.length("v").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, "new", 3), (2, "x", 1), (3, "z", 1)]
