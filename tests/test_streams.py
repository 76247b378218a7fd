import datetime
import random
import re

import pytest

from gridlake.operators.series import sustained_excursion
from gridlake.streaming import streams


def machine(values, high, low, hold):
    """The rule, one sample after another."""
    out, up, down, before = [], None, None, None
    for t, f in values:
        for side in ("up", "down"):
            beyond = f > high if side == "up" else f < low
            away = before is not None and (f > before if side == "up" else f < before)
            since = up if side == "up" else down
            if not beyond:
                since = None
            elif since is None:
                since = t
            elif not away:
                since = None
            elif t - since >= hold:
                out.append((t, f, side))
            up, down = (since, down) if side == "up" else (up, since)
        before = f
    return out


def sample(seed):
    rng = random.Random(seed)
    return [(m, i / 4, 60 + rng.choice([-1.6, -1.4, -1.2, 0.0, 1.2, 1.4, 1.6, 1.8])) for m in range(6) for i in range(60)]


def test_batch_rule_against_state_machine(spark):
    rows = sample(1)
    found = sorted(tuple(r) for r in sustained_excursion(spark.createDataFrame(rows, "machine long, t double, value double")).collect())
    wanted = sorted((m, *x) for m in range(6) for x in machine([(t, v) for k, t, v in rows if k == m], 61.0, 59.0, 0.5))
    assert found == wanted and found


@pytest.mark.parametrize("segment", [0.25, 0.6, 3.0, 1000.0])
def test_any_segments_of_a_series_give_the_same(spark, segment):
    """Segments of one sample, of a few, of all; ties of t, and machines that have gaps of whole segments."""
    rng = random.Random(11)
    rows = [(m, rng.choice([i / 4, i / 4, i * 1.0]), 60 + rng.choice([-1.6, -1.4, -1.2, 0.0, 1.2, 1.4, 1.4, 1.6, 1.8, 2.0])) for m in range(12) for i in range(80)]
    found = sustained_excursion(spark.createDataFrame([*rows, (1, 2.0, None)], "machine long, t double, value double"), start=1.0, segment=segment)
    wanted = sorted((m, *x) for m in range(12) for x in machine(sorted((t, v) for k, t, v in rows if k == m and t >= 1.0), 61.0, 59.0, 0.5))
    assert sorted(tuple(r) for r in found.collect()) == wanted and wanted


def test_no_window_over_the_samples_of_a_whole_machine(spark):
    rows = spark.range(10).selectExpr("id as machine", "double(id) as t", "60D as value")
    plan = sustained_excursion(rows)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
    assert windows and all("segment#" in line for line in windows)
    # those along a whole machine order the segments' functions; those of samples are dealt by segment too
    assert not any(re.search(r"\[machine#\d+L\], \[t#", line) for line in windows)


def test_samples_in_any_order_equal_the_batch(spark, tmp_path):
    """A replay shuffled over micro-batches, with the watermark behind: what waits leaves in order of time."""
    rng = random.Random(4)
    rows = [(m, i / 4, 60 + rng.choice([-1.6, -1.4, -1.2, 0.0, 1.2, 1.4, 1.4, 1.6, 1.8, 2.0])) for m in range(4) for i in range(240)]
    at = datetime.datetime(2024, 1, 1)
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 4))  # up to 4 seconds late
    kind = "machine long, t double, value double, ts timestamp"
    for part in range(5):
        some = [(*r, at + datetime.timedelta(seconds=r[1])) for r in order[part * 192 : (part + 1) * 192]]
        spark.createDataFrame(some, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = sorted(tuple(r) for r in streams.drained(streams.stream_excursion_in_order(source, "5 seconds"), streams.ROCKSDB).collect())
    mark = max(r[1] for r in rows) - 5
    wanted = [tuple(r) for r in sustained_excursion(spark.createDataFrame(rows, "machine long, t double, value double")).collect() if r.t < mark]
    assert found == sorted(wanted) and found


def test_stream_equals_batch_on_a_replay(spark, tmp_path):
    rows = sample(2)
    for part in range(3):  # in order of time, over three files
        some = [r for r in rows if part * 5 <= r[1] < (part + 1) * 5]
        spark.createDataFrame(some, "machine long, t double, value double").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    source = spark.readStream.schema("machine long, t double, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = streams.stream_excursion(source).writeStream.format("memory").queryName("excursions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = sorted(tuple(r) for r in spark.table("excursions").collect())
    assert found == sorted(tuple(r) for r in sustained_excursion(spark.createDataFrame(rows, "machine long, t double, value double")).collect())


def test_static_joins_of_streams(spark):
    ratings = spark.createDataFrame([(1, 2, "1", 5.0, 0.0, 0.0)], "from_bus long, to_bus long, ckt string, rate_a double, rate_b double, rate_c double")
    rows = spark.createDataFrame([(1, 1, 2, "1", 3.0, 4.1), (2, 1, 2, "1", 3.0, 3.9)], "event_idx int, from_bus long, to_bus long, ckt string, p double, q double")
    assert [r.event_idx for r in streams.stream_violations(rows, ratings).collect()] == [1]
    seen = spark.createDataFrame([("Bus ", 1, "", 1.0), ("bus", 2, "", 2.0)], "type string, bus_id long, tag string, value double")
    asked = spark.createDataFrame([("BUS", 2, None)], "type string, bus_id long, tag string")
    assert [r.value for r in streams.stream_watch(seen, asked).collect()] == [2.0]


def test_silent_machines_are_forgotten(spark, tmp_path):
    kind = "machine long, t double, value double, ts timestamp"
    at = lambda m, t, v: (m, t, v, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t))
    files = [[at(1, 0.0, 61.2), at(2, 0.0, 60.0)], [at(2, 100.0, 60.0)], [at(2, 101.0, 60.0)], [at(1, 102.0, 61.4), at(1, 103.0, 61.6)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    for name, forget, wanted in (("kept", None, [102.0, 103.0]), ("forgotten", 10.0, [103.0])):
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        stream = streams.stream_excursion(source, lateness="5 seconds", forget_seconds=forget)
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert sorted(r.t for r in spark.table(name).collect()) == wanted
    with pytest.raises(ValueError):
        streams.stream_excursion(source, forget_seconds=1.0)


def test_clocks_of_silent_machines_start_anew_in_order(spark, tmp_path):
    """What the state of a machine says is dropped after a silence, by timer or by the next sample, in whatever order files come."""
    kind = "machine long, t double, value double, ts timestamp"
    at = lambda m, t, v: (m, t, v, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t))
    files = [[at(1, 1.0, 61.4), at(1, 0.0, 61.2), at(1, 30.0, 61.6)], [at(2, 40.0, 60.0)], [at(1, 31.0, 61.8), at(2, 45.0, 60.0)], [at(3, 90.0, 60.0)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    for forget, wanted in ((None, [1.0, 30.0, 31.0]), (10.0, [1.0, 31.0])):
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        found = streams.drained(streams.stream_excursion_in_order(source, "20 seconds", forget_seconds=forget), streams.ROCKSDB)
        assert sorted(r.t for r in found.collect()) == wanted
