"""The paged source, once and as a stream, and the quarantine of faulty rows."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from sediment.sources import landing, paged, quarantine
from sediment.sources.log import Log


def document(ids, total, sort="timestamp"):
    return json.dumps({"total": total, "sortBy": sort, "positions": [{"id": i, "name": f"n{i}"} for i in ids]})


def landed(place, passes, size=2):
    """passes: {number: [ids of each page]}."""
    for number, pages in passes.items():
        total = sum(map(len, pages))
        for n, ids in enumerate(pages):
            file = place / f"pass={number}" / f"offset={n * size}.json"
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(document(ids, total), encoding="utf-8")
    return f"{place}/pass={{pass}}/offset={{offset}}.json"


def load(spark, url, **options):
    spark.dataSource.register(paged.PagedIndex)
    reader = spark.read.format("paged_index").option("url", url).option("size", 2)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_one_partition_for_each_page(spark, tmp_path):
    url = landed(tmp_path, {1: [[1, 2], [3, 4], [5]], 2: [[7, 8]]})
    rows = load(spark, url, again="true")
    assert rows.rdd.getNumPartitions() == 5  # three pages, and both ends again
    got = sorted((r["pass"], r.page, r.again, r.total, tuple(p.id for p in r.positions)) for r in rows.collect())
    assert got == [(1, 0, False, 5, ("1", "2")), (1, 0, True, 5, ("1", "2")), (1, 1, False, 5, ("3", "4")), (1, 2, False, 5, ("5",)), (1, 2, True, 5, ("5",))]
    assert [tuple(p.id for p in r.positions) for r in load(spark, f"file://{url}", **{"pass": "2"}).collect()] == [("7", "8")]


def test_the_scans_run_on_the_source(spark, tmp_path):
    """Strict and tolerant scans, validation, fingerprints and rows by id, from pages as they were landed."""
    url = landed(tmp_path, {1: [[1, 2], [2, 3]], 2: [[1, 2], [3, 4]]})
    both = load(spark, url, again="true").unionByName(load(spark, url, again="true", **{"pass": "2"}))
    number, rows = landing.complete(both)
    assert number == 2 and sorted((r.id, r.page) for r in rows.collect()) == [("1", 0), ("2", 0), ("3", 1), ("4", 1)]
    with pytest.raises(landing.IncompleteIndex):  # the ends weren't read again
        landing.complete(load(spark, url, **{"pass": "2"}))
    assert sorted(r[0] for r in load(spark, url).select(landing.fingerprint()).collect()) == ["1,2", "2,3"]


def test_pages_that_cannot_be_read_are_faults(spark, tmp_path):
    url = landed(tmp_path, {1: [[2 * n, 2 * n + 1] for n in range(60)]})
    (tmp_path / "pass=1" / "offset=10.json").unlink()
    rows = load(spark, url)
    assert rows.count() == 60 and [(r.page, r.error.split(":")[0]) for r in rows.where("error is not null").collect()] == [(5, "FileNotFoundError")]
    assert landing.tolerant(rows, 60).count() == 118
    (tmp_path / "pass=1" / "offset=12.json").write_text('{"total": 120, "positions": [', encoding="utf-8")
    (tmp_path / "pass=1" / "offset=14.json").write_text('[1, 2]', encoding="utf-8")
    found = {r.page: r.fault for r in load(spark, url).select("page", landing.page_faults().alias("fault")).where("fault is not null").collect()}
    assert sorted(found) == [5, 6, 7]
    with pytest.raises(landing.IncompleteIndex):
        landing.tolerant(load(spark, url), 60)
    assert [r.error is not None for r in load(spark, str(tmp_path / "none" / "{offset}")).collect()] == [True]


def test_pages_over_http_are_tried_again(spark):
    asked = {}

    class Index(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            offset = int(self.path.rpartition("=")[2])
            asked[offset] = asked.get(offset, 0) + 1
            if offset == 2 and asked[offset] == 1:
                self.send_error(503)
                return
            body = document([offset, offset + 1], 6).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Index)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = load(spark, f"http://127.0.0.1:{server.server_port}/index?start={{offset}}").collect()
    finally:
        server.shutdown()
    assert sorted(p.id for r in rows for p in r.positions) == list("012345") and asked[2] == 2


def test_a_stream_of_pages_goes_on(spark, tmp_path):
    """Pages that come later are read when the stream starts again; one that isn't full waits."""
    spark.dataSource.register(paged.PagedIndex)

    def run():
        stream = spark.readStream.format("paged_index").option("url", url).option("size", 2).option("pages", 2).load()
        query = stream.select("page", F.explode("positions.id").alias("id")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.page, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    url = landed(tmp_path / "in", {1: [["a", "b"], ["c", "d"], ["e", "f"], ["g"]]})
    first = [(0, "a"), (0, "b"), (1, "c"), (1, "d"), (2, "e"), (2, "f")]
    assert run() == first
    landed(tmp_path / "in", {1: [["a", "b"], ["c", "d"], ["e", "f"], ["g", "h"], ["i", "j"]]})
    assert run() == first + [(3, "g"), (3, "h"), (4, "i"), (4, "j")]


SCHEMA = "k int, tags array<string>"
RULES = {"no k": "value.k is not null", "low": "value.k >= 0", "no name": "trim(name) <> ''"}
ROWS = [
    ("a", "x", '{"k": 1, "tags": ["t"]}', []),
    ("b", "x", '{"k": 1', ["broken"]),
    ("c", "x", None, ["missing"]),
    ("d", "x", "  ", ["missing"]),
    ("e", "x", '{"k": "one"}', ["broken"]),
    ("f", " ", '{"tags": []}', ["no k", "low", "no name"]),
    ("g", None, '{"k": -4, "other": 1}', ["low", "no name"]),
    ("h", "x", "[1]", ["broken"]),
    ("i", "x", '"text"', ["broken"]),
    ("j", "x", "null", ["broken"]),
    ("k", "x", '{"k": 2, "tags": "t"}', ["broken"]),
    ("l", "x", '{"k": 3.5}', ["broken"]),
    ("m", "x", '{"k": 5, "tags": [' + ", ".join(['"t"'] * 5000) + "]}", []),
]


def frame(spark, rows):
    return spark.createDataFrame([r[:3] for r in rows], "id string, name string, raw string")


def test_reasons(spark):
    found = quarantine.judged(frame(spark, ROWS), "raw", SCHEMA, RULES)
    assert {r.id: r.reasons for r in found.collect()} == {r[0]: r[3] for r in ROWS}
    good, faults = quarantine.split(found)
    assert {r.id: r.value.k for r in good.collect()} == {"a": 1, "m": 5} and faults.count() == 11
    assert all(r.value is None for r in faults.collect() if r.reasons in (["broken"], ["missing"]))


def test_strict_scans_end_at_the_first_fault(spark):
    good = [r for r in ROWS if not r[3]]
    assert quarantine.strict(frame(spark, good), "raw", SCHEMA).select("value.k").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        quarantine.strict(frame(spark, ROWS[:2]), "raw", SCHEMA).select("value").collect()


def test_faults_are_replayed_and_nothing_counts_twice(spark, tmp_path):
    put = quarantine.Quarantine(Log(spark, str(tmp_path / "q"), "id", 4), "raw", SCHEMA, RULES)
    assert put.ingest(frame(spark, ROWS[:5] + ROWS[:2]), 0) == 1
    assert put.ingest(frame(spark, ROWS[:5]), 0) == 1  # the same batch again
    put.ingest(frame(spark, ROWS[3:]), 1)  # two of its rows came before
    assert put.good().count() + put.faults().count() == len(ROWS) and put.faults().count() == 11
    put.replay(frame(spark, [("b", "y", '{"k": 7}'), ("e", "y", '{"k": []}'), ("a", "y", '{"k": 99}'), ("none", "y", '{"k": 1}')]))
    good = {r.id: (r.value.k, r.name, r.attempts) for r in put.good().collect()}
    assert good == {"a": (1, "x", 1), "b": (7, "x", 2), "m": (5, "x", 1)}
    assert {r.id: r.attempts for r in put.faults().collect()} == {r[0]: 2 if r[0] == "e" else 1 for r in ROWS if r[3] and r[0] != "b"}
    assert put.log.compact() == 4 and put.good().count() == 3


def test_the_quarantine_takes_a_stream(spark, tmp_path):
    for part in (ROWS[:6], ROWS[6:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put = quarantine.Quarantine(Log(spark, str(tmp_path / "q"), "id", 4), "raw", SCHEMA, RULES)
    stream = spark.readStream.schema("id string, name string, raw string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(put.ingest).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None and put.good().count() == 2 and put.faults().count() == 11 and put.log.version() == 2


def test_a_task_reads_many_pages(spark, monkeypatch):
    """Tasks grow with a part of the pages, and each page is read once, its ends again."""
    monkeypatch.setattr(paged, "fetched", lambda url: {"total": 2000, "positions": []})
    reader = paged._Reader({"url": "{offset}", "again": "true"}, paged.StructType.fromDDL(paged.SCHEMA))
    runs = reader.partitions()
    assert len(runs) == 6 and sorted((p.offset, p.again) for r in runs for p in r.pages) == sorted([*((k, False) for k in range(0, 2000, 10)), (0, True), (1990, True)])
    assert [row[1] for row in reader.read(runs[0])] == list(range(paged.PER_TASK))
