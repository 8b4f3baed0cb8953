"""The streaming forms give the same rows from one file and from many files out of order."""

from compare import rows
from conftest import DATA

from tidegrid.streaming import windows


def test_files_out_of_order(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").toPandas().sample(frac=1, random_state=3)
    (tmp_path / "events.parquet").mkdir()
    for k in range(130):
        events.iloc[k::130].to_parquet(tmp_path / "events.parquet" / f"part-{k:03d}.parquet", index=False, coerce_timestamps="us")
    for query in (windows.tumbling, windows.sliding):
        assert rows(query(spark, str(tmp_path)).toPandas()) == rows(query(spark, DATA).toPandas())


def scattered(events, folder, jitter):
    """Files in time order, but each event is delivered up to `jitter` files late; a tenth is delivered twice."""
    import os

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    events = events.sort_values("ts").reset_index(drop=True)
    place = np.arange(len(events)) * 40 // len(events)
    late = place + rng.integers(0, jitter + 1, len(events))
    again = events[rng.random(len(events)) < 0.1]
    everything = pd.concat([events.assign(file=late), again.assign(file=place[again.index] + rng.integers(0, jitter + 1, len(again)))])
    (folder / "events.parquet").mkdir(parents=True)
    for k, part in everything.groupby("file"):
        path = folder / "events.parquet" / f"part-{k:03d}.parquet"
        part.drop(columns="file").sample(frac=1, random_state=int(k)).to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1_600_000_000 + k, 1_600_000_000 + k))  # files are read in the order of their times
    return (events.ts.iloc[-1] - events.ts.iloc[0]) / 40 * (jitter + 2)


def test_keyed_state_does_not_depend_on_files(spark, tmp_path):
    import duckdb
    from tidegrid.streaming import keyed

    events = spark.read.parquet(f"{DATA}/events.parquet").toPandas()
    late = scattered(events, tmp_path, 3)
    span = f"{int(late.total_seconds()) + 1} seconds"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT DISTINCT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    stream = lambda: keyed.events(spark, str(tmp_path), files=4)
    steps = {
        "stream_once": lambda s: keyed.once(s, span).select("event_id", "symbol", "owner"),
        "stream_sessions": lambda s: keyed.sessions(keyed.once(s, span)),
        "stream_compact": lambda s: keyed.changes(keyed.once(s, span)),
    }
    for name, step in steps.items():
        got = keyed.replayed(stream(), step, name).toPandas()
        if name == "stream_sessions":
            got["usd"] = got.usd.round(6)
        assert rows(got) == rows(con.execute(keyed.ORACLE_SQL[name]).df()), name


def test_gap_itself_is_within_a_session(spark, tmp_path):
    import pandas as pd
    from tidegrid.streaming import keyed

    at = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:01:00", "2024-01-01 00:02:00.000001", "2024-01-01 00:02:30"], format="ISO8601")
    frame = pd.DataFrame({"event_id": [1, 2, 3, 4], "ts": at, "user_id": [1] * 4, "event_type": ["x"] * 4, "value": [1.0, 2, 4, 8], "props": ['{"k": 1}'] * 4})
    frame.to_parquet(tmp_path / "events.parquet", index=False, coerce_timestamps="us")
    got = keyed.stream_sessions(spark, str(tmp_path)).orderBy("first").collect()
    assert [(r.n, r.usd) for r in got] == [(2, 3.0), (2, 12.0)]
    assert [r.event_id for r in keyed.stream_compact(spark, str(tmp_path)).collect()] == [1]


def test_too_late_events_are_dropped(spark, tmp_path):
    """An event older than the lateness allows, in a later file, is not counted: state is bounded."""
    import os

    import pandas as pd
    from tidegrid.streaming import keyed

    (tmp_path / "events.parquet").mkdir()
    for k, (i, day) in enumerate([(1, "2024-01-01"), (2, "2024-03-01"), (4, "2024-03-02"), (3, "2024-01-02"), (5, "2024-03-03")]):
        frame = pd.DataFrame({"event_id": [i], "ts": pd.to_datetime([day]), "user_id": [1], "event_type": ["x"], "value": [1.0], "props": ['{"k": 1}']})
        path = tmp_path / "events.parquet" / f"{k}.parquet"
        frame.to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1_600_000_000 + k,) * 2)
    got = keyed.replayed(keyed.events(spark, str(tmp_path), files=1), lambda s: keyed.once(s, "5 days").select("event_id", "symbol"), "late").collect()
    assert [r.event_id for r in keyed.replayed(keyed.events(spark, str(tmp_path), files=1), lambda s: keyed.changes(s.withWatermark("ts", "5 days")), "late").collect()] == [1]
    assert sorted(r.event_id for r in got) == [1, 2, 4, 5]


def test_changes_keep_no_events_in_python():
    """A key's state is one value; arrays of a slice pass through while the slices are read, in whatever order."""
    from types import SimpleNamespace

    from pyspark.sql import Row
    from tidegrid.streaming import keyed

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

    value, step, read = Value(), keyed.Changes(), []
    step.init(SimpleNamespace(getValueState=lambda *a: value))  # there is no list of events

    def slices():
        for start, event_id, first, last, inner in ((60, 20, 4, 4, []), (0, 10, 1, 3, [11, 12]), (120, 30, 5, 5, [])):
            read.append(start)
            yield Row(start=start, event_id=event_id, first=first, last=last, inner=inner)

    out = step.handleInputRows(("x",), slices(), None)
    assert next(out).event_ids == [11, 12] and read == [60, 0]
    assert [r.event_ids for r in out] == [[10], [20], [30]] and value.held == (5,)
    assert [r.event_ids for r in step.handleInputRows(("x",), iter([Row(start=180, event_id=40, first=5, last=6, inner=[41])]), None)] == [[41]] and value.held == (6,)
