"""Delimited sources on hand-written dirty files (FIXTURES.md §1)."""

import os

import pytest
from pyspark.sql import functions as F

from panelstats.functions.dates import month_extract, month_parse
from panelstats.operators.transforms import dedupe_first, duplicate_keys
from panelstats.sources import csv as C

LOCALE = "date;price;share;volume;;;\r\n2011-04;7,25;1.4;03.250125;;;\r\n2011-05;7,5;1.9;;;;\r\n2011-06;NA;1.7;0.5;;;\r\n"
DIRTY = ',mean price,share,mean volume,extra\n2011-04,"7.25\t",1.4,NA,a\nDec 2012,7.5,1.9,3.0125,b\n'


@pytest.fixture
def scratch(spark):
    return C.scratch_path(spark, "unit")


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", newline="") as f:
        f.write(text)
    return path


def test_locale_file(spark, scratch):
    path = _write(scratch + "-locale", "panel.csv", LOCALE)
    raw = C.drop_unnamed(C.read_text_table(spark, path, sep=";"))
    assert raw.columns == ["date", "price", "share", "volume"]
    typed = C.convert_columns(raw, {"price": ",", "share": ".", "volume": "."}, month_col="date")
    rows = typed.orderBy("date").collect()
    assert [r.price for r in rows] == [7.25, 7.5, None]
    assert rows[0].volume == pytest.approx(3.250125)      # leading zero "03.250125"
    assert rows[1].volume is None                          # empty cell
    assert str(rows[0].date) == "2011-04-01"


def test_dirty_positional(spark, scratch):
    path = _write(scratch + "-dirty", "rows.csv", DIRTY)
    raw = C.read_text_table(spark, path)
    assert raw.columns[0] == "_c0"                              # empty first header
    ren = C.rename_positional(raw, ["month_text", "price", "part", "volume"])
    assert ren.columns == ["month_text", "price", "part", "volume", "extra"]
    typed = C.convert_columns(ren, {"price": ".", "part": ".", "volume": "."}, month_col="month_text")
    rows = typed.orderBy("month_text").collect()
    assert rows[0].price == 7.25                                 # quoted value with a tab
    assert rows[0].volume is None                                  # NA token
    assert str(rows[1].month_text) == "2012-12-01"              # 'Dec 2012'
    with pytest.raises(ValueError):
        C.rename_positional(raw.select("_c0"), ["a", "b"])


def test_require_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="missing"):
        C.require_columns(df, ["a", "z"])


def test_month_functions(spark):
    df = spark.createDataFrame([("Dec 2001",), ("2001-12",), ("garbage",), ("200112",), ("12/2001",)], "s string")
    y, m = month_extract(F.col("s"))
    out = df.select("s", month_parse(F.col("s")).alias("d"), y.alias("y"), m.alias("m")).collect()
    got = {r.s: (str(r.d) if r.d else None, r.y, r.m) for r in out}
    assert got["Dec 2001"][0] == "2001-12-01" and got["2001-12"][0] == "2001-12-01"
    assert got["garbage"] == (None, None, None)
    assert got["2001-12"][1:] == (2001, 12)
    assert got["200112"][1:] == (2001, 1)          # fewer than 7 characters → month 1
    assert got["12/2001"][1:] == (None, None)      # characters 1-4 are not a year


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([("a", 2, 20.0), ("a", 1, 10.0), ("a", 1, 11.0), ("b", 5, 1.0)],
                               "k string, t int, v double")
    out = {r.k: r for r in dedupe_first(df, ["k"], ["t"], ["v"]).collect()}
    assert (out["a"].t, out["a"].v, out["a"].n_dup) == (1, 10.0, 3)
    assert duplicate_keys(df, ["k", "t"]).count() == 1
