"""Raw records, files with broken quotes, and wide tables."""

from __future__ import annotations

import pytest

from weblattice.operators.pivot import Attribute, filled_cells, resolved_cells, wide_table
from weblattice.sources.records import parse_file, parse_record, parse_records, recovered_records

RAW = "record_id long, run_id long, export string, source_document string, line_number int, raw string, header string"


def rows(*raws, export="internal"):
    return [(i, 1, export, "f.csv", i, r, "clash") for i, r in enumerate(raws, 1)]


def test_reasons_and_types(spark):
    data = rows("﻿ Address ,STATUS CODE,crawl depth,x", '"https://a/?q=""x"",y",200,12345678901,z', "https://b,99,1,z", "https://c,301,,z", "https://d,301,1", 'e,"2"00,1,z', 'f,"200,1,z', "", None, "g,,99999999999999999999,z", ",200,1,z")
    got = {r.record_id: r for r in parse_records(spark.createDataFrame(data, RAW)).collect()}
    assert {k: r.reason for k, r in got.items()} == {2: None, 3: "value", 4: None, 5: "columns", 6: "quoting", 7: "quoting", 10: None, 11: "value"}
    assert (got[2].address, got[2].status_code, got[2].crawl_depth) == ('https://a/?q="x",y', 200, 12345678901)
    assert got[4].crawl_depth is None and got[10].crawl_depth == 2**63 - 1


def test_analytics_header_missing_and_empty_table(spark):
    data = rows("source_url,clicks,target_url", "a,9007199254740991,b", "a,9007199254740992,b", "a,-1,b", "a,1,", export="analytics") + [(50, 2, "analytics", "g.csv", 2, "a,1,b", "")]
    got = {r.record_id: r.reason for r in parse_records(spark.createDataFrame(data, RAW)).collect()}
    assert got == {2: None, 3: "value", 4: "value", 5: "value", 50: "header"}
    assert parse_records(spark.createDataFrame([], RAW)).collect() == []


def test_reading_goes_on_at_the_next_record_start():
    text = 'a,b,c\n1,"x\ny",3\n4,"broken,6\n7,8,9\n"ok","fine",12\n13,"late"x,15\n16,17\n18,19,20'
    got = [(line, None if bad else fields, bad and bad.reason) for line, fields, bad in parse_file(text)]
    assert got == [
        (1, ["a", "b", "c"], None), (2, ["1", "x\ny", "3"], None), (4, None, "quoting"), (5, ["7", "8", "9"], None), (6, ["ok", "fine", "12"], None), (7, None, "quoting"),
        (9, ["18", "19", "20"], None),  # line 8 is no record start: too few fields
    ]
    assert parse_record('a,"b""c"')[0] == ["a", 'b"c']


@pytest.mark.parametrize("records", [2, 5000])
def test_files_are_put_together_and_recovered(spark, records):
    data = rows("a,b,c", "1,2,3", '4,"broken,6', "7,8,9", "10,11", '"12","x\ny",13')
    got = [(r.reason, tuple(r.fields or ())) for r in recovered_records(spark.createDataFrame(data, RAW), records).orderBy("chunk", "line").collect()]
    assert got == [(None, ("a", "b", "c")), (None, ("1", "2", "3")), ("quoting", ()), (None, ("7", "8", "9")), ("columns", ()), (None, ("12", "x\ny", "13"))]


ATTRIBUTES = [Attribute("a.count", "count"), Attribute("real", "real"), Attribute("share", "ratio"), Attribute("flag", "flag")]
TIDY = "run_id long, policy string, metric string, value string, exported_at timestamp_ntz, row_id long, cast_failures string"


def test_wide_table_keeps_large_tiny_and_failed_values(spark):
    import datetime as dt

    t = lambda k: dt.datetime(2025, 1, k)
    data = [
        (1, "P", "A-Count", "1,234", t(1), 1, "x"), (1, "P", "acount", "9007199254740993", t(2), 2, "x"), (1, "P", "a.count", "bad", t(3), 3, "x"), (1, "P", "REAL", "1e30", t(1), 4, "x"),
        (1, "P", "share", "12,5 %", t(1), 5, "x"), (1, "P", "flag", "Yes", t(1), 6, "x"), (1, "P", "flag", "no", t(1), 7, "x"), (1, "P", "other", "1", t(1), 8, "x"),
        (2, None, "real", "1e-15", None, 9, "x"), (2, None, "a.count", "1e-15", None, 10, "x"), (2, None, "share", "1.5", None, 11, "x"), (2, None, None, "1", None, 12, "x"), (3, "P", "real", None, t(1), 13, "x"),
    ]
    df = spark.createDataFrame(data, TIDY)
    got = {(r.run_id, r.policy): r for r in wide_table(df, ATTRIBUTES).collect()}
    one, two, three = got[1, "P"], got[2, None], got[3, "P"]
    assert (one["a__count"], one["real"], one["share"], one["flag"]) == (9007199254740993, 1e30, 0.125, False)
    assert [tuple(x) for x in one["cast_failures"]] == [("a.count", 1, "bad")]
    assert two["real"] == 1e-15 and two["a__count"] is None and len(two["cast_failures"]) == 2
    assert three["real"] is None and [tuple(x) for x in three["cast_failures"]] == [("real", 1, None)]
    cells = {(r.run_id, r.metric): r.value_e6 for r in filled_cells(wide_table(df, ATTRIBUTES), ATTRIBUTES).collect()}
    assert cells == {(1, "share"): 125000, (1, "flag"): 0, (2, "real"): 0}
    assert wide_table(df.limit(0), ATTRIBUTES).columns == ["run_id", "policy", "a__count", "real", "share", "flag", "cast_failures"]
    assert resolved_cells(df.limit(0), ATTRIBUTES, ["run_id"]).collect() == []
    with pytest.raises(ValueError):
        wide_table(df, [Attribute("policy", "real")])
