"""The order of day and month by vote of a column."""

import datetime as dt

import pytest

from tallyloom.operators import dates
from tallyloom.operators import ledger as L
from tallyloom.operators import medallion as M


def test_each_file_is_read_by_the_order_of_most(spark):
    rows = [("us", "03/04/2024"), ("us", "12/31/2024"), ("uk", "03/04/2024"), ("uk", "31/12/2024"), ("vague", "03/04/2024"), ("vague", "05/06/2024"), (None, "01/02/2024"), (None, "01/30/2024"), ("mixed", "12/25/2024"), ("mixed", "12/26/2024"), ("mixed", "25/12/2024"), ("mixed", "01/02/2024"), ("iso", "2024-03-04"), ("iso", None), ("iso", "x")]
    got = dates.inferred(spark.createDataFrame(rows, "file string, text string"), "text", ["file"]).collect()
    day = {(r["file"], r["text"]): (r["date_order"], r["txn_date"] and r["txn_date"].strftime("%m-%d")) for r in got}
    assert day["us", "03/04/2024"] == ("mdy", "03-04") and day["us", "12/31/2024"] == ("mdy", "12-31")
    assert day["uk", "03/04/2024"] == ("dmy", "04-03") and day["vague", "03/04/2024"] == ("dmy", "04-03")
    assert day[None, "01/02/2024"] == ("mdy", "01-02")
    # a file of both is read by the order of most, and the others still as they can be
    assert day["mixed", "01/02/2024"] == ("mdy", "01-02") and day["mixed", "25/12/2024"] == ("mdy", "12-25")
    assert day["iso", "2024-03-04"] == ("dmy", "03-04") and day["iso", "x"] == ("dmy", None)
    assert len(got) == len(rows)


def test_one_vote_for_all_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("03/04/2024",), ("02/28/2024",)], "text string")
    assert [r["txn_date"].month for r in dates.inferred(df, "text", []).orderBy("text").collect()] == [2, 3]
    assert dates.inferred(df.limit(0), "text", []).count() == 0


def test_normalise_by_vote(spark):
    rows = [("a.csv", "03/04/2024", "x", "1"), ("a.csv", "03/25/2024", "x", "1"), ("b.csv", "03/04/2024", "x", "1")]
    df = spark.createDataFrame(rows, "source_file string, Date string, memo string, amount string")
    assert sorted(r["txn_date"] for r in L.normalise(df, date_order="vote", file_col="source_file").collect()) == [dt.date(2024, 3, 4), dt.date(2024, 3, 25), dt.date(2024, 4, 3)]
    assert sorted(r["txn_date"] for r in L.normalise(df, date_order="vote").collect()) == [dt.date(2024, 3, 4), dt.date(2024, 3, 4), dt.date(2024, 3, 25)]
    with pytest.raises(ValueError, match="vote"):
        L.normalise(df, date_order="ymd")


def test_bronze_rows_of_a_file_vote(spark):
    raws = [("a", '{"Txn Date": "03/04/2024"}'), ("a", '{"Txn Date": "03/25/2024"}'), ("b", '{"date": "03/04/2024"}'), ("b", "no json"), ("c", None)]
    df = spark.createDataFrame(raws, "source_file string, raw_content string")
    assert {r["source_file"]: r["date_order"] for r in M.file_votes(df).collect()} == {"a": "mdy", "b": "dmy", "c": "dmy"}
