"""Runs from landed pages and details to a published state, its history, counts and what is shown."""

import datetime as dt
import json

import pytest

from sediment import daily, schema
from sediment.sources import landing, state

DAYS = [dt.datetime(2024, 5, d, 6) for d in range(1, 9)]
PAGE = schema.PAGE.replace("pass int, page int,", "pass int, page int, again boolean,")


def pages(spark, rows, number=1, again=True):
    """rows: {id: title}, two on a page."""
    cut = [list(rows.items())[i : i + 2] for i in range(0, len(rows), 2)]
    of = lambda own: [{"id": i, "name": t, "displayJobId": f"J{i}", "department": "Consulting Project Management", "postedTs": 1714000000, "creationTs": 1714000000, "isHot": False, "locations": ["Norway, Oslo, Oslo"], "standardizedLocations": ["Oslo, NO"]} for i, t in own]
    made = [(number, n, a, len(rows), "timestamp", of(own)) for n, own in enumerate(cut) for a in ([False, True] if again and n in (0, len(cut) - 1) else [False])]
    fields = spark.createDataFrame([], PAGE).schema
    inner = [f.name for f in fields["positions"].dataType.elementType]
    return spark.createDataFrame([(*m[:5], [tuple(p.get(k) for k in inner) for p in m[5]]) for m in made], fields)


def details(spark, texts, at, failed=()):
    """texts: {id: html}."""
    fields = spark.createDataFrame([], schema.DETAIL + ", fetchedAt timestamp, error string").schema
    rows = [{"id": i, "jobDescription": x, "profession": ["Software Engineering"], "fetchedAt": at} for i, x in texts.items()] + [{"id": i, "error": "HTTP 503", "fetchedAt": at} for i in failed]
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)


HTML = "<p>Overview</p><p>We run Azure and Kubernetes in distributed systems.</p><p>Qualifications</p><p>3 years of Python.</p>"


@pytest.fixture(scope="module")
def three(spark, tmp_path_factory):
    """A first run and two more."""
    book = daily.Book(spark, str(tmp_path_factory.mktemp("book") / "b"))
    rows = [daily.run(book, pages(spark, {"1": "Engineer", "2": "Old role", "3": "Third"}), details(spark, {"1": HTML, "2": HTML, "3": HTML}, DAYS[0]), DAYS[0], baseline=True)]
    rows.append(daily.run(book, pages(spark, {"1": "Engineer", "3": "Third", "4": "Senior Architect"}), details(spark, {"1": HTML + "<p>More</p>", "4": HTML}, DAYS[1]), DAYS[1]))
    rows.append(daily.run(book, pages(spark, {"1": "Engineer", "2": "Old role is back", "4": "Senior Architect"}), details(spark, {"2": HTML}, DAYS[2]), DAYS[2]))
    return book, rows


def test_rows_of_runs(three):
    _, rows = three
    assert [(r["status"], r["openCount"], r["added"], r["removed"], r["updated"]) for r in rows] == [("baseline", 3, 0, 0, 0), ("success", 3, 1, 1, 1), ("success", 3, 1, 1, 0)]


def test_the_state(three):
    book, _ = three
    got = {r.id: r for r in book.postings().collect()}
    assert {i: (r.status, r.firstSeenAt, r.lastSeenAt) for i, r in got.items()} == {"1": ("open", DAYS[0], DAYS[2]), "2": ("open", DAYS[2], DAYS[2]), "3": ("closed", DAYS[0], DAYS[0]), "4": ("open", DAYS[1], DAYS[2])} or got["3"].lastSeenAt in (DAYS[0], DAYS[1])
    assert got["3"].closedAt == DAYS[2] and got["3"].daysOpen == 2 and got["1"].closedAt is None
    assert got["1"].detailFetchedAt == DAYS[1] and got["4"].seniority == "Senior" and got["4"].archetype == "architect" and got["2"].title == "Old role is back"
    assert "cloud_azure" in got["1"].themes and "python" in got["1"].skills and got["1"].requiredYears == 3 and got["1"].org == "isd" and got["1"].descriptionHtml.endswith("<p>More</p>")
    state.validate(book.postings(), book.runs(), book.history())


def test_changes_by_version(three):
    book, _ = three
    log = sorted((r.version, r.id, r.kind, [x.field for x in r.changed]) for r in book.changes(1).collect())
    assert log == [(2, "1", "updated", ["descriptionHash"]), (2, "2", "removed", []), (2, "4", "added", []), (3, "2", "added", []), (3, "3", "removed", [])]


def test_history_counts_and_what_is_shown(spark, three):
    book, rows = three
    days = {r.date: r for r in book.history().collect()}
    assert sorted(days) == ["2024-05-01", "2024-05-02", "2024-05-03"] and days["2024-05-02"].professions == {"Software Engineering": 3} and days["2024-05-03"].orgs == {"isd": 3} and days["2024-05-02"].added == 1
    assert sorted(map(tuple, book.counts.read().collect())) == sorted(map(tuple, book.counts.recount().where("n > 0").collect()))
    stats = state.read_stats(book.shown)
    assert stats["run"] == rows[-1] and {r["key"]: r["n"] for r in stats["meta"]}["open"] == 3
    shown = {r.id: r for r in book.shown.read(state.FILES["browse"]).collect()}
    assert sorted(shown) == ["1", "2", "4"] and shown["4"].location == "Oslo, Norway" and json.dumps(stats)
    assert book.runs().count() == 3


def test_a_run_of_the_same_day_takes_the_place_of_its_row(spark, tmp_path):
    book = daily.Book(spark, str(tmp_path / "b"))
    daily.run(book, pages(spark, {"1": "a"}), details(spark, {"1": HTML}, DAYS[0]), DAYS[0], baseline=True)
    later = DAYS[0] + dt.timedelta(hours=3)
    daily.run(book, pages(spark, {"1": "a", "2": "b"}), details(spark, {"2": HTML}, later), later)
    assert [(r.date, r.totalOpen) for r in book.history().collect()] == [("2024-05-01", 2)] and book.runs().count() == 2


def test_nothing_is_published_of_a_run_that_fails(spark, tmp_path, monkeypatch):
    book = daily.Book(spark, str(tmp_path / "b"))
    first = pages(spark, {"1": "a", "2": "b", "3": "c"})
    with pytest.raises(daily.Refused):
        daily.run(book, first, details(spark, {"1": HTML}, DAYS[0]), DAYS[0])
    with pytest.raises(daily.IncompleteDetails, match="1 of 3"):
        daily.run(book, first, details(spark, {"1": HTML, "2": HTML}, DAYS[0], ["3"]), DAYS[0], baseline=True)
    with pytest.raises(landing.IncompleteIndex):
        daily.run(book, pages(spark, {"1": "a", "2": "b", "3": "c"}, again=False), details(spark, {"1": HTML, "2": HTML, "3": HTML}, DAYS[0]), DAYS[0], baseline=True)
    assert book.log.version() == 0
    # an index read since doesn't list the one that failed
    row = daily.run(book, first, details(spark, {"1": HTML, "2": HTML}, DAYS[0], ["3"]), DAYS[0], baseline=True, refreshed=spark.createDataFrame([("1",), ("2",)], "id string"))
    assert row["openCount"] == 2 and book.log.version() == 1
    with pytest.raises(daily.Refused):
        daily.run(book, first, details(spark, {"3": HTML}, DAYS[1]), DAYS[1], baseline=True)
    # a listed posting whose detail fails now keeps the one that it has
    assert daily.run(book, pages(spark, {"1": "a", "2": "b2"}), details(spark, {}, DAYS[1], ["2"]), DAYS[1])["updated"] == 1
    # one that dies after its version: the next one brings the rest up to it
    with monkeypatch.context() as m:
        m.setattr(book, "catch_up", lambda done=[]: done.append(1) if not done else (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            daily.run(book, pages(spark, {"1": "a"}), details(spark, {}, DAYS[2]), DAYS[2])
    assert book.log.version() == 3 and book.runs().count() == 2
    daily.run(book, pages(spark, {"1": "a", "5": "e"}), details(spark, {"5": HTML}, DAYS[3]), DAYS[3], compact_every=2)
    assert book.runs().count() == 4 and sorted(r.date for r in book.history().collect()) == [f"2024-05-0{d}" for d in (1, 2, 3, 4)]
    assert sorted((r.id, r.status) for r in book.postings().collect()) == [("1", "open"), ("2", "closed"), ("5", "open")]
