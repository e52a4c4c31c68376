"""Landed pages, documents, versions of a state, and change capture: what goes through, what is refused, and what a writer that dies leaves behind."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sediment import schema
from sediment.operators import changes
from sediment.sources import landing, state

UTC = dt.timezone.utc


def pages(spark, rows):
    """rows: (pass, page, again, total, ids, order)."""
    made = [(p, n, a, t, o, [{"id": None if i is None else str(i), "name": f"title {i}"} for i in ids]) for p, n, a, t, ids, o in rows]
    return spark.createDataFrame(made, "pass int, page int, again boolean, total long, sortBy string, positions array<struct<id:string,name:string>>")


def whole(number=1, total=4):
    return [(number, 0, False, total, [1, 2], "timestamp"), (number, 1, False, total, [3, 4], "timestamp"), (number, 0, True, total, [2, 1], "timestamp"), (number, 1, True, total, [3, 4], "timestamp")]


def test_a_whole_pass_is_taken(spark):
    number, rows = landing.complete(pages(spark, whole()))
    assert number == 1 and sorted(r.id for r in rows.collect()) == ["1", "2", "3", "4"]


@pytest.mark.parametrize(
    "spoiled",
    [
        [(1, 0, False, 4, [1, 2], "timestamp"), (1, 1, False, 4, [2, 3], "timestamp")],  # ids overlap
        [(1, 0, False, 4, [1, 2], "timestamp"), (1, 1, False, 5, [3, 4], "timestamp")],  # the total moves
        [(1, 0, False, 4, [1, 2], "timestamp"), (1, 1, False, 4, [3, None], "timestamp")],  # a blank id
        [(1, 0, False, 4, [1, 2], "relevance"), (1, 1, False, 4, [3, 4], "timestamp")],  # another order
        [(1, 0, False, 4, [1, 2], "timestamp"), (1, 1, False, 4, [], "timestamp")],  # an empty page
        [*whole()[:2], (1, 0, True, 4, [9, 1], "timestamp"), whole()[3]],  # the first page moved
        [*whole()[:3], (1, 1, True, 4, [4, 9], "timestamp")],  # the last page moved
        whole()[:2],  # no page was read again
        whole()[:3],  # the last page wasn't
        [*whole()[:2], whole()[3]],  # the first wasn't
    ],
)
def test_spoiled_passes_are_refused_and_never_put_together(spark, spoiled):
    with pytest.raises(landing.IncompleteIndex):
        landing.complete(pages(spark, spoiled))
    number, rows = landing.complete(pages(spark, spoiled + whole(2)))
    assert number == 2 and rows.count() == 4


def test_tolerant_scan(spark):
    many = [(1, n, False, 100, [2 * n, 2 * n + 1], "timestamp") for n in range(50)]
    assert landing.tolerant(pages(spark, many), 50).count() == 100
    assert landing.tolerant(pages(spark, many[1:]), 50).count() == 98  # one page of fifty may fail
    with pytest.raises(landing.IncompleteIndex):
        landing.tolerant(pages(spark, many[2:]), 50)
    last = landing.tolerant(pages(spark, [(1, 0, False, 2, [7, 8], "timestamp"), (1, 1, False, 2, [8], "timestamp")]), 2)
    assert {r.id: r.page for r in last.collect()} == {"7": 0, "8": 1}  # the last page wins


def test_fingerprints_go_by_ids(spark):
    got = pages(spark, [(1, 0, False, 2, [2, 10, 1], "timestamp"), (1, 1, False, 2, [1, 2, 10], "timestamp")]).select(landing.fingerprint().alias("f")).collect()
    assert got[0].f == got[1].f == "1,10,2"


def test_documents(tmp_path):
    path = str(tmp_path / "a" / "b.json")
    assert state.read_document(path, {"none": 1}) == {"none": 1}
    state.write_document(path, {"é": [1, None]}, pretty=True)
    assert state.read_document(path) == {"é": [1, None]} and [p.name for p in (tmp_path / "a").iterdir()] == ["b.json"]
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(json.JSONDecodeError):
        state.read_document(str(tmp_path / "broken.json"), {})


def test_layout_and_derived(spark, tmp_path, monkeypatch):
    """The document and the rows of one run are seen together, also if a writer dies between the two."""
    assert state.layout("/r/")["browse"] == "/r/jobs.min"
    store = state.Store(spark, str(tmp_path))
    seen = lambda: (state.read_stats(store), store.read(state.FILES["browse"]).count())
    assert state.write_derived(store, {"open": 2, "é": [None]}, spark.range(3)) == 1 and seen() == ({"open": 2, "é": [None]}, 3)
    with pytest.raises(Exception, match="broken"):
        state.write_derived(store, {"open": 9}, spark.range(1).select(F.raise_error(F.lit("broken")).alias("x")))
    assert seen() == ({"open": 2, "é": [None]}, 3)
    state.write_derived(store, {"open": 3}, spark.range(2))
    assert seen() == ({"open": 3}, 2) and state.read_stats(store, 1)["open"] == 2


DAY = dt.datetime(2024, 5, 2, 6, 0, 0)


def tables(spark, **wrong):
    """A state that holds together; wrong changes a field of it: table_field=value."""
    postings = [{"id": str(i), "title": "t", "status": s, "firstSeenAt": DAY, "lastSeenAt": DAY, "locations": [], "hasDetail": True, "descriptionHtml": "<p>x</p>", "detailFetchedAt": DAY, "closedAt": DAY if s == "closed" else None} for i, s in enumerate(["open", "open", "closed"])]
    run = {"status": "success", "date": "2024-05-02", "startedAt": DAY, "finishedAt": DAY, "openCount": 2, "missingDetail": 0, "searchErrors": 0, "detailErrors": 0, "added": 1, "removed": 1, "updated": 0}
    day = {"date": "2024-05-02", "at": DAY, "totalOpen": 2, "added": 1, "removed": 1, "updated": 0, "themes": {"a": 1}, "professions": {}, "orgs": {}}
    for key, value in wrong.items():
        name, field = key.split("_", 1)
        {"postings": postings[0], "runs": run, "history": day}[name][field] = value

    def frame(rows, kinds):
        fields = spark.createDataFrame([], kinds).schema
        return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)

    return {"postings": frame(postings, schema.POSTING), "runs": frame([run], schema.RUN), "history": frame([day], schema.HISTORY)}


def test_a_valid_state_passes(spark):
    state.validate(**tables(spark))


@pytest.mark.parametrize(
    ("wrong", "fault"),
    [
        ({"postings_id": "1"}, "repeated ids"), ({"postings_id": ""}, "id"), ({"postings_status": "gone"}, "status"), ({"postings_title": None}, "status"), ({"postings_descriptionHtml": " "}, "detail"), ({"postings_hasDetail": False}, "detail"),
        ({"postings_locations": None}, "locations"), ({"postings_status": "closed"}, "closed"), ({"runs_status": "partial"}, "run"), ({"runs_missingDetail": 1}, "run coverage"), ({"runs_openCount": 3}, "open count"), ({"runs_status": "baseline"}, "baseline"),
        ({"runs_added": -1}, "run counts"), ({"history_date": "2024-5-2"}, "history"), ({"history_themes": {"a": -1}}, "history"), ({"history_totalOpen": 9}, "history of the latest run"), ({"history_added": 2}, "history of the latest run"),
    ],
)
def test_each_rule_of_a_state(spark, wrong, fault):
    with pytest.raises(state.InvalidState, match=fault):
        state.validate(**tables(spark, **wrong))


def test_versions(spark, tmp_path):
    store = state.Store(spark, str(tmp_path / "s"))
    assert store.version() == 0
    assert store.publish(tables(spark), 0) == 1 and store.version() == 1
    assert store.restore()["postings"].count() == 3
    with pytest.raises(state.Moved):
        store.publish(tables(spark), 0)  # a late writer
    with pytest.raises(state.InvalidState):
        store.publish(tables(spark, runs_openCount=7), 1)
    assert store.version() == 1
    assert store.publish({"other": spark.range(4)}, 1) == 2 and store.read("other").count() == 4 and store.read("postings", 1).count() == 3


def test_a_writer_that_dies_blocks_nobody(spark, tmp_path):
    store = state.Store(spark, str(tmp_path / "s"))
    store.publish({"x": spark.range(1)}, 0)
    store.write({"x": spark.range(2)})  # tables written, never pointed at
    assert store.version() == 1 and store.read("x").count() == 1
    assert store.publish({"x": spark.range(3)}, 1) == 2 and store.read("x").count() == 3


def test_two_writers_of_one_version(spark, tmp_path):
    one, two = (state.Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.publish({"x": spark.range(1)}, 0)
    folders = one.write({"x": spark.range(2)}), two.write({"x": spark.range(3)})
    one.point(2, folders[0])
    with pytest.raises(state.Moved):
        two.point(2, folders[1])
    assert two.version() == 2 and two.read("x").count() == 2


def test_a_snapshot_against_itself_changes_nothing(spark):
    live = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "id int, title string, tags array<int>")
    now = F.to_timestamp(F.lit("2024-05-01"))
    empty = spark.createDataFrame([], "id int, title string, tags array<int>, status string, first_seen timestamp, last_seen timestamp, closed_at timestamp, days_open long")
    known = changes.next_state(empty, live, "id", now)
    assert {r.kind for r in changes.diff(known, live, "id", ["title", "tags"]).collect()} == {"same"}
    again = changes.next_state(known, live, "id", now)
    assert sorted(map(str, again.collect())) == sorted(map(str, known.collect()))
    turned = spark.createDataFrame([(1, "a", [2, 1]), (2, None, None)], "id int, title string, tags array<int>")
    assert [(r.id, [x.field for x in r.changed]) for r in changes.diff(known, turned, "id", ["title", "tags"]).where("kind = 'updated'").collect()] == [(1, ["tags"])]


def test_latest_rows_may_hold_maps(spark):
    rows = spark.createDataFrame([(1, 1, {"a": 1}), (1, 2, {"b": 2}), (2, 1, None)], "id int, at int, m map<string,int>")
    assert {r.id: r.m for r in changes.latest_struct(rows, ["id"], ["at"]).collect()} == {1: {"b": 2}, 2: None}


def test_dense_days_fill_gaps(spark):
    from sediment.operators import series

    rows = spark.createDataFrame([("2024-02-27",), ("2024-02-27",), ("2024-03-01",), ("2023-01-01",), (None,)], "d string").select(F.to_date("d").alias("d"))
    days = series.dense_days(rows, F.col("d"), 5)
    assert [(str(r.day), r.n) for r in days.orderBy("day").collect()] == [("2024-02-26", 0), ("2024-02-27", 2), ("2024-02-28", 0), ("2024-02-29", 0), ("2024-03-01", 1)]
    assert series.dense_days(rows.where("d is null"), F.col("d"), 5).collect() == []
    assert [r.mean for r in series.moving_average(days, 1).orderBy("day").collect()] == [None, 2 / 3, 2 / 3, 1 / 3, None]
    assert str(series.peak(days).first().day) == "2024-02-27"
