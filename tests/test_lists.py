import datetime as dt

from panelmark.operators import lists

DAY = dt.date(2001, 1, 1)
SERIES = ("a", "X")


def readings(spark, n):
    rows = [(*SERIES, DAY + dt.timedelta(k), float(k)) for k in range(n)]
    return spark.createDataFrame(rows, "entity string, indicator_code string, date date, value double")


def test_newest_readings_say_whether_there_are_more(spark):
    for n, more in ((0, None), (3, False), (4, True), (9, True)):
        rows = lists.newest_readings(readings(spark, n), 3).collect()
        assert {r.truncated for r in rows} == ({more} if n else set())
        assert sorted(r.value for r in rows) == [float(k) for k in range(max(0, n - 3), n)]


def test_sources_without_observations_are_listed(spark):
    sources = spark.createDataFrame([("s", True, None), ("t", False, None)], "source string, is_active boolean, last_run timestamp")
    facts = spark.createDataFrame([("s",), ("s",), (None,)], "source string")
    assert [(r.source, r.observations) for r in lists.list_sources(sources, facts).collect()] == [("s", 2), ("t", 0)]


def test_messages_come_once_in_order(spark):
    rows = [(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (1, 3, None), (2, 0, None)]
    results = spark.createDataFrame(rows, "answer_id int, ordinal int, message string")
    assert [(r.answer_id, r.detail) for r in lists.distinct_messages(results).collect()] == [(1, "b a")]


def test_last_turns_that_say_anything(spark):
    turns = spark.createDataFrame([(1, k, "user", t) for k, t in enumerate([" one ", None, "  ", "two", "three"])], "conv_id int, turn int, role string, text string")
    assert sorted((r.turn, r.content) for r in lists.recent_messages(turns, 2).collect()) == [(3, "two"), (4, "three")]


def test_a_window_holds_both_its_ends(spark):
    rows = lists.in_window(readings(spark, 5), DAY, DAY + dt.timedelta(2)).collect()
    assert sorted(r.value for r in rows) == [0.0, 1.0, 2.0]
