"""The table functions: their columns follow the table, options are checked beforehand, and odd rows have a result."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from tessera.functions import tools


@pytest.fixture
def sql(spark):
    tools.register(spark)
    spark.sql("SELECT * FROM VALUES ('a', 1, 10.0D, 'x'), ('a', 2, NULL, 'y'), ('b', 1, -40.0D, NULL), (NULL, 5, 0.0D, 'z') AS v(place, time, temperature_max, unit)").createOrReplaceTempView("seen")
    spark.sql("SELECT * FROM VALUES ('u', 1, array(1.0D, 0.0D)), ('u', 10, array(2.0D, 0.0D)), ('u', 2, array(0.0D, 1.0D)), ('u', 3, NULL), ('u', 4, array(0.0D, 0.0D)), ('v', 5, array(1.0D, 0.0D)), (NULL, 6, array(1.0D)) AS v(user_id, id, embedding)").createOrReplaceTempView("items")
    return lambda q: [tuple(r) for r in spark.sql(q).collect()]


def test_columns_follow_the_table(spark, sql):
    assert spark.sql("SELECT * FROM weather_current(TABLE(seen))").schema.simpleString() == "struct<place:string,time:int,temperature_max:double,unit:string>"
    got = sql("SELECT * FROM weather_current(TABLE(seen), unit => 'fahrenheit') ORDER BY place NULLS FIRST")
    assert got == [(None, 5, 32.0, "fahrenheit"), ("a", 2, None, "fahrenheit"), ("b", 1, -40.0, "fahrenheit")]
    assert sql("SELECT place, unit FROM weather_air_quality(TABLE(seen), unit => 'kelvin') WHERE place = 'a'") == [("a", "celsius")]
    assert len(sql("SELECT * FROM weather_forecast(TABLE(seen), days => 1)")) == 3 and sql("SELECT * FROM weather_forecast(TABLE(SELECT * FROM seen WHERE time > 9))") == []


@pytest.mark.parametrize("call", [
    "weather_forecast(TABLE(seen), days => 17)", "weather_forecast(TABLE(seen), days => 0)", "weather_historical(TABLE(seen), '2024-13-01')", "weather_historical(TABLE(seen), 'today')", "weather_current(TABLE(seen), place => 'town')",
    "weather_geocode(TABLE(SELECT place AS query, time AS pos FROM seen), limit => 11)", "memory_search(TABLE(items), array(1.0D), 'u', limit => 0)", "ocr_lines(TABLE(seen))",
])
def test_options_are_checked_beforehand(spark, sql, call):
    with pytest.raises(PySparkException):
        spark.sql(f"SELECT * FROM {call}").schema


def test_memory(sql):
    assert sql("SELECT id, score FROM memory_search(TABLE(items), array(1.0D, 0.0D), 'u', limit => 2)") == [(1, 1.0), (10, 1.0)]  # of equal ones the smaller text
    assert [r[0] for r in sql("SELECT id FROM memory_search(TABLE(items), array(1.0D, 0.0D), 'u')")] == [1, 10, 2] and sql("SELECT id FROM memory_search(TABLE(items), array(1.0D), 'w')") == []
    assert sorted(r[0] for r in sql("SELECT id FROM memory_delete(TABLE(items), 10)")) == [1, 2, 3, 4, 5, 6]
    assert sorted(r[0] for r in sql("SELECT id FROM memory_wipe(TABLE(items), 'u')")) == [5, 6]
    got = sql("SELECT user_id, error FROM memory_insert(TABLE(SELECT user_id, IF(id = 5, ' ', repeat('x', id * 5000)) AS text FROM items WHERE id > 4), default_user => 'me')")
    assert sorted(got, key=str) == [("me", None), ("u", "text must be at most 32768 characters"), ("v", "text must not be blank")]


def test_recognition(spark, sql):
    rows = [("1", '{"pages": [{"page_number": 3, "lines": [{"text": "a", "confidence": 1}, {}]}, {"lines": null}]}'), ("2", "[]"), ("3", None), ("4", '{"pages": [7]}'), ("5", '{"pages": null}')]
    spark.createDataFrame(rows, "name string, payload string").createOrReplaceTempView("scans")
    got = sql("SELECT name, page_number, line_no, text, confidence, error IS NULL FROM ocr_lines(TABLE(scans), lang => 'de') ORDER BY name, line_no")
    assert got == [("1", 3, 1, "a", 1.0, True), ("1", 3, 2, None, None, True), *[(n, None, None, None, None, False) for n in "234"]]
