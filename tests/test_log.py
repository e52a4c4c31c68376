"""The log of a keyed table, and change capture on streams that split their snapshots: the same state as with whole rewrites, whatever happens between."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sediment.operators import changes
from sediment.sources import log as logs
from sediment.sources import state
from sediment.streaming import capture

SCHEMA = "id long, name string, n int, gone boolean"


def size(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def version(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_log_is_what_was_last_said_of_each_key(spark, tmp_path):
    """Random versions, with compactions between: every kept version, and the log of changes."""
    rng, log, want, said = random.Random(4), logs.Log(spark, str(tmp_path / "l"), "id", 4), {0: {}}, []
    at = 0
    for step in range(14):
        rows = {k: (k, rng.choice("abc"), rng.randrange(9), rng.random() < 0.3) for k in rng.sample(range(25), rng.randrange(0, 9))}
        assert log.append(version(spark, list(rows.values())), at) == at + 1
        held = {k: r[:3] for k, r in rows.items() if not r[3]}
        want[at + 1] = {k: v for k, v in want[at].items() if k not in rows} | held
        at += 1
        said += [(at, *r) for r in rows.values()]
        if step % 3 == 2:
            moved = log.compact()
            assert moved == at + 1 or not log.manifest()["changes"]
            want[moved], at = want[at], moved
    for v in range(1, at + 1):
        assert {r.id: tuple(r) for r in log.read(version=v).collect()} == want[v]
    assert sorted((r.version, r.id, r.name, r.n, r.gone) for r in log.changes().collect()) == sorted(said)
    assert all(len(level) < logs.FAN for level in log.manifest()["archive"])
    log.vacuum(keep=3, grace=0)
    assert log.versions() == [at - 2, at - 1, at]
    for v in log.versions():
        assert {r.id: tuple(r) for r in log.read(version=v).collect()} == want[v]
    assert sorted((r.version, r.id, r.name, r.n, r.gone) for r in log.changes().collect()) == sorted(said)
    named = {json.loads(log._folder(v))["base"].get(b) for v in log.versions() for b in "0123"}
    assert {p.name for p in (tmp_path / "l").glob("data-*")} >= named - {None}


def test_what_is_written_follows_the_changes(spark, tmp_path):
    log = logs.Log(spark, str(tmp_path / "l"), "id", 16)
    log.append(spark.range(50_000).selectExpr("id", "sha2(cast(id as string), 256) as name", "1 as n"), 0)
    assert log.compact() == 2
    whole = size(tmp_path / "l")
    log.append(version(spark, [(3, "new", 2, False), (7, None, None, True)]), 2)
    assert size(tmp_path / "l") - whole < whole / 100
    before = size(tmp_path / "l")
    log.compact()
    assert size(tmp_path / "l") - before < whole / 4  # two buckets of sixteen, and the changes
    assert log.read().count() == 49_999 and log.read().where("id = 3").first().name == "new"


def test_a_compaction_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    log = logs.Log(spark, str(tmp_path / "l"), "id", 4)
    log.append(version(spark, [(k, "a", k, False) for k in range(9)]), 0)
    log.append(version(spark, [(1, "b", 1, False), (2, None, None, True)]), 1)
    before = sorted(map(tuple, log.read().collect()))
    with monkeypatch.context() as m:
        m.setattr(log, "point", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            log.compact()
    assert log.version() == 2 and sorted(map(tuple, log.read().collect())) == before
    left = {p.name for p in (tmp_path / "l").glob("data-*")}
    assert log.vacuum(keep=9) == []  # they are young: a writer may be at work
    assert len(log.vacuum(keep=9, grace=0)) == 2 and len(left) == 4
    assert log.compact() == 3 and sorted(map(tuple, log.read().collect())) == before


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    one, two = (logs.Log(spark, str(tmp_path / "l"), "id", 4) for _ in range(2))
    one.append(version(spark, [(1, "a", 1, False)]), 0)
    with pytest.raises(state.Moved):
        two.append(version(spark, [(1, "b", 1, False)]), 0)
    # two looked before one published, and comes to the claim after it
    old = two.manifest()
    one.append(version(spark, [(1, "c", 1, False)]), 1)
    with monkeypatch.context() as m:
        m.setattr(two, "manifest", lambda version=None: old)
        with pytest.raises(state.Moved):
            two.append(version(spark, [(1, "d", 1, False), (5, "e", 1, False)]), 1)
        with pytest.raises(state.Moved):
            two.compact()
    assert [tuple(r) for r in two.read().collect()] == [(1, "c", 1)]
    assert [r.name for r in two.changes().orderBy("version").collect()] == ["a", "c"]  # the loser's changes are nowhere
    with pytest.raises(state.InvalidState):
        one.append(version(spark, [(1, "x", 1, False), (1, "y", 1, False)]), 2)
    with pytest.raises(state.InvalidState):
        one.append(version(spark, [(None, "x", 1, False)]), 2)
    assert one.version() == 2


DAYS = [dt.datetime(2024, 5, d) for d in range(1, 9)]


def paged(spark, at, rows, per=2):
    """Rows of one snapshot, so many on a page."""
    return [(at, n // per, len(rows), i, t, n) for n, (i, t) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "snapshot timestamp, page int, total int, id int, title string, at int").withColumnRenamed("at", "place")


def made(spark, path, **options):
    return capture.Capture(logs.Log(spark, str(path), "id", 4), ["title"], ["place"], **options)


def rewritten(spark, snapshots):
    """The state after snapshots, rewritten whole for each."""
    now = None
    for at, rows in snapshots:
        live = spark.createDataFrame(rows, "id int, title string")
        if now is None:
            now = spark.createDataFrame([], "id int, title string, status string, first_seen timestamp, last_seen timestamp, closed_at timestamp, days_open long")
        now = changes.next_state(now, live, "id", F.lit(at))
        now = spark.createDataFrame(now.collect(), now.schema)
    return sorted(tuple(r) for r in now.collect())


FOUR = [
    (DAYS[0], [(1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, "five")]),
    (DAYS[1], [(1, "ONE"), (3, "three"), (5, "five")]),
    (DAYS[2], [(1, "ONE"), (3, "three"), (5, "five")]),
    (DAYS[3], [(2, "two again"), (3, "three"), (6, "six")]),
]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_snapshots_split_over_any_batches(spark, tmp_path, seed):
    """Pages in any order and any batches, several snapshots in one batch, batches run again: the state and the changes of whole snapshots."""
    rng = random.Random(seed)
    rows = [r for at, own in FOUR for r in paged(spark, at, own)]
    if seed:
        rng.shuffle(rows)
    run = made(spark, tmp_path / "s", wait=dt.timedelta(days=30), every=2, grace=0)
    number = 0
    while rows:
        n = rng.randrange(1, 6)
        batch, rows = frame(spark, rows[:n]), rows[n:]
        run(batch, number)
        if rng.random() < 0.4:
            run(batch, number)  # it failed after its work, and is run again
        number += 1
    got = run.state().select("id", "title", "status", "first_seen", "last_seen", "closed_at", "days_open")
    assert sorted(tuple(r) for r in got.collect()) == rewritten(spark, FOUR)
    log = sorted((r.changed_at.day, r.id, r.kind, [tuple(x) for x in r.changed]) for r in run.changes().collect() if r.changed_at > DAYS[0])
    assert log == [(2, 1, "updated", [("title", "one", "ONE")]), (2, 2, "removed", []), (2, 4, "removed", []), (4, 1, "removed", []), (4, 2, "added", []), (4, 5, "removed", []), (4, 6, "added", [])]
    assert run.refused() == [] and not list((tmp_path / "s" / "pending").glob("batch=*/at=*"))


def test_a_snapshot_that_never_ends_is_refused(spark, tmp_path):
    run = made(spark, tmp_path / "s", wait=dt.timedelta(days=2))
    run(frame(spark, paged(spark, *FOUR[0])), 0)
    run(frame(spark, paged(spark, DAYS[1], FOUR[1][1])[:2]), 1)  # its last page is missing
    run(frame(spark, paged(spark, DAYS[2], FOUR[2][1])), 2)
    assert run.log.version() == 1  # the later one waits for it
    run(frame(spark, paged(spark, DAYS[4], FOUR[3][1])), 3)
    assert run.refused() == ["20240502T000000000000"] and run.log.version() == 3
    got = sorted(tuple(r) for r in run.state().select("id", "title", "status", "first_seen", "last_seen", "closed_at", "days_open").collect())
    assert got == rewritten(spark, [FOUR[0], (DAYS[2], FOUR[2][1]), (DAYS[4], FOUR[3][1])])


def test_late_rows_are_not_passed_over(spark, tmp_path):
    run = made(spark, tmp_path / "s")
    run(frame(spark, paged(spark, *FOUR[1])), 0)
    with pytest.raises(capture.LateRows):
        run(frame(spark, paged(spark, *FOUR[0])), 1)
    aside = made(spark, tmp_path / "s", late="aside")
    aside(frame(spark, paged(spark, *FOUR[0])), 1)
    assert aside.log.version() == 1 and spark.read.parquet(str(tmp_path / "s" / "late")).count() == 5


def test_a_stream_of_pages(spark, tmp_path):
    """A real stream, started twice on one checkpoint, one file for each batch, pages of a snapshot in different files."""
    source, place = tmp_path / "in", tmp_path / "s"
    files = [paged(spark, *FOUR[0])[:3], paged(spark, *FOUR[0])[3:] + paged(spark, *FOUR[1])[:1], paged(spark, *FOUR[1])[1:], paged(spark, *FOUR[2]), paged(spark, *FOUR[3])]
    schema = frame(spark, files[0]).schema
    for part in (files[:2], files[2:]):
        for rows in part:
            frame(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = capture.start(stream, made(spark, place, wait=dt.timedelta(days=30)), str(tmp_path / "check"))
        query.awaitTermination(300)
        assert query.exception() is None
    run = made(spark, place)
    got = sorted(tuple(r) for r in run.state().select("id", "title", "status", "first_seen", "last_seen", "closed_at", "days_open").collect())
    assert got == rewritten(spark, FOUR)


def test_daily_counts_of_a_stream(spark, tmp_path):
    rows = [(DAYS[0], "a"), (DAYS[0], "a"), (DAYS[0], "b"), (DAYS[1], "a"), (DAYS[4], "a")]
    spark.createDataFrame(rows, "ts timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    query = capture.daily_counts(stream, "ts", "k").writeStream.format("memory").queryName("daily_counts_test").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted((r.window.start.day, r.key, r.n) for r in spark.table("daily_counts_test").collect())
    assert got == [(1, "a", 2), (1, "b", 1), (2, "a", 1)]  # the last day is still open
