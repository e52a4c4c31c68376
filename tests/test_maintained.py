"""Counts kept from changes against counting again, after random runs of opening, closing, reopening and edits."""

import random

import pytest

from sediment.operators.maintained import Breakdowns
from sediment.sources.log import Log

SCHEMA = "id long, status string, place string, tags array<string>, gone boolean"
DIMS = {"place": "place", "tag": "tags", "upper": "upper(place)"}


def size(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_follow_the_changes(spark, tmp_path, seed):
    rng = random.Random(seed)
    log, counts = Log(spark, str(tmp_path / "s"), "id", 4), Log(spark, str(tmp_path / "c"), "cell", 4)
    kept = Breakdowns(log, counts, DIMS, "status = 'open'")
    for step in range(8):
        rows = [(k, rng.choice(["open", "closed"]), rng.choice(["a", "b", "", None]), rng.choice([None, [], ["x"], ["x", "y", "x"], ["z"]]), rng.random() < 0.1) for k in rng.sample(range(30), rng.randrange(1, 12))]
        log.append(spark.createDataFrame(rows, SCHEMA), log.version())
        if step in (2, 5):
            log.compact()
        if step % 3 != 1:  # some versions are taken together
            kept.refresh()
            assert sorted(map(tuple, kept.read().collect())) == sorted(map(tuple, kept.recount().collect()))
    kept.refresh()
    before = counts.version()
    assert kept.refresh() == before  # nothing new
    log.append(spark.createDataFrame([(1, "open", "c", ["w"], False)], SCHEMA), log.version())
    log.append(spark.createDataFrame([(2, "open", "c", ["w"], False)], SCHEMA), log.version())
    log.vacuum(keep=1, grace=0)  # the version that the counts stand at is gone
    kept.refresh()
    assert sorted(map(tuple, kept.read().collect())) == sorted(map(tuple, kept.recount().collect()))
    assert all(r.n > 0 for r in kept.read().collect())


def test_the_cost_follows_the_changes(spark, tmp_path):
    log, counts = Log(spark, str(tmp_path / "s"), "id", 16), Log(spark, str(tmp_path / "c"), "cell", 4)
    kept = Breakdowns(log, counts, {"place": "place"})
    log.append(spark.range(40_000).selectExpr("id", "concat('p', id % 5000) as place"), 0)
    log.compact()
    kept.refresh()
    whole = size(tmp_path / "c")
    log.append(spark.createDataFrame([(7, "p9", False), (8, None, True)], "id long, place string, gone boolean"), log.version())
    keys = log.changes(log.version() - 1).select("id")
    read = log.read_keys(keys, 2).inputFiles()
    based = [f for f in read if "bucket=" in f]
    assert 0 < len(based) <= 2 and len(log.read(version=2).inputFiles()) == 16
    kept.refresh()
    assert size(tmp_path / "c") - whole < whole / 10
    found = {r.value: r.n for r in kept.read().where("value in ('p7', 'p8', 'p9')").collect()}
    assert found == {"p7": 7, "p8": 7, "p9": 9}
