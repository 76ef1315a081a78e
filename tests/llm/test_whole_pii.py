"""Dates in every reading and of every year."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from speckle.llm import pii


def test_day_first_and_distant_dates_are_replaced(spark):
    values = ["25/12/2001", "31/01/1850", "1850-06-01", "2100/01/01", "31.12.1899", "12/25/2150", "0001-01-01", "9999-12-31", "2001-12-25"]
    df = pii.pseudonymised(spark.createDataFrame([(i, f"On {v}, see.") for i, v in enumerate(values)], "doc_id long, text string"), "k").orderBy("doc_id")
    for r, v in zip(df.collect(), values):
        new = r.text[3:-6]
        assert r.n_found == 1 and r.kinds == ["date"] and v not in r.text and len(new) == len(v)
        assert [c for c in new if not c.isdigit()] == [c for c in v if not c.isdigit()]
    stay = ["25/13/2001", "31/04/2001", "29/02/2001", "0000-01-01", "00/12/2001"]
    df = pii.pseudonymised(spark.createDataFrame(list(enumerate(stay)), "doc_id long, text string"), "k").orderBy("doc_id")
    assert [(r.text, r.n_found) for r in df.collect()] == [(v, 0) for v in stay]


def test_day_first_dates_stay_apart_and_day_first(spark):
    days = [date(1880, 1, 1) + timedelta(3 * k) for k in range(6000)]
    both = [f"{d:%d/%m/}{d.year:04}" for d in days if d.day > 12] + [f"{d:%m/%d/}{d.year:04}" for d in days]
    df = spark.createDataFrame([(m,) for m in both], "m string").select("m", pii.date(F.col("m"), "k").alias("n"))
    got = {r.m: r.n for r in df.collect()}
    assert len(set(got.values())) == len(got) == len(both)
    for m, n in got.items():
        a, b, y = map(int, n.split("/"))
        assert (a > 12) == (int(m[:2]) > 12)
        date(y, b, a) if a > 12 else date(y, a, b)
        assert (1901 <= y <= 2096) == (1901 <= int(m[-4:]) <= 2096)
