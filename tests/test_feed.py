import pytest

from loomwright.operators.feed import RowFeed, StopRule
from loomwright.staging import fresh_dir


@pytest.fixture
def feed(spark):
    df = spark.range(10).selectExpr("(id * 7) % 10 AS k", "concat('t', (id * 7) % 10) AS t").repartition(3)
    return lambda path, **kw: RowFeed.create(df, ["k"], path, **{"range_rows": 4} | kw)


def taken(feed, **rule):
    return [r.k for r in feed.rows(StopRule(**rule))]


def test_each_run_goes_on_where_the_last_one_stopped(spark, feed):
    path = fresh_dir(spark, "feed")
    assert taken(feed(path), rows=3) == [0, 1, 2]
    assert taken(feed(path), rows=9) == [3, 4, 5, 6, 7, 8, 9, 0, 1]
    assert feed(path).position == (1, 2)
    assert taken(feed(path), cycles=2) == [2, 3, 4, 5, 6, 7, 8, 9, 0, 1] * 2
    assert taken(RowFeed(spark, path, 4), rows=0) == [] and feed(path).position == (3, 2)


def test_minutes_and_stop_file(spark, feed, tmp_path):
    path, now = fresh_dir(spark, "feed"), [0.0]
    timed = feed(path, clock=lambda: now[0])
    got = []
    for r in timed.rows(StopRule(minutes=1)):
        got.append(r.k)
        now[0] += 25
    assert got == [0, 1, 2, 3] and timed.position == (0, 4)  # a range is not cut
    stop = tmp_path / "stop"
    for r in timed.rows(StopRule(cycles=5, stop_file=str(stop))):
        got.append(r.k)
        if r.k == 1:
            stop.write_text("")
    assert got == [*range(10), 0, 1, 2, 3]
    assert taken(timed, rows=5, stop_file=str(stop)) == []
    stop.unlink()
    assert taken(timed, rows=1) == [4]


def test_a_failed_range_is_given_again_and_only_its_part_is_read(spark, feed):
    path = fresh_dir(spark, "feed")
    with pytest.raises(RuntimeError):
        for frame in feed(path).frames(StopRule(cycles=1)):
            assert "PushedFilters: [IsNotNull(ordinal), GreaterThanOrEqual(ordinal,0), LessThanOrEqual(ordinal,3)]" in frame._jdf.queryExecution().toString()
            raise RuntimeError
    assert taken(feed(path), rows=5) == [0, 1, 2, 3, 4]


def test_rules_and_empty_tables(spark):
    for bad in ({}, {"rows": 1, "cycles": 1}, {"stop_file": "x"}):
        with pytest.raises(ValueError, match="one of"):
            StopRule(**bad)
    empty = RowFeed.create(spark.range(0), ["id"], fresh_dir(spark, "feed"))
    assert list(empty.rows(StopRule(cycles=3))) == [] and list(empty.rows(StopRule(minutes=1))) == []
