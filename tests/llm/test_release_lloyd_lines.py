"""Release of turns, clusters of vectors and repeated lines against plain Python over odd rows, and against SQL over the smallest tables."""

import hashlib
import math
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

from sediment.llm import common, line_runs, lloyd, queries, release


def hashes(k, conv, turn):
    return zlib.crc32(f"{k}:{conv}:{turn}".encode())


def replayed(rows):
    """{(conv_id, turn): result} in plain Python."""
    turns = {}
    for conv, turn, text in rows:
        n, crc = turns.get((conv, turn), (0, 1 << 40))
        turns[conv, turn] = n + 1, min(crc, zlib.crc32((text or "").encode()))
    out = {k: (None,) * 6 + (n,) for k, (n, _) in turns.items() if None in k}
    of = defaultdict(list)
    for conv, turn in turns.keys() - out.keys():
        of[conv].append(turn)
    for conv, own in of.items():
        done = []
        for p, turn in enumerate(sorted(own)):
            back, at = hashes(0, conv, turn) % 3, 7 * p
            if back and p >= back:
                status, _, _, last = done[p - back]
                if status != "delivered":
                    done.append(("blocked", 0, None, None))
                    continue
                at = max(at, last)
            faulty, repaired, first = hashes(1, conv, turn) % 101 < 35, 7 * p + hashes(2, conv, turn) % 101, at
            for a in range(1, 6):
                if not faulty or at >= repaired and hashes(a + 2, conv, turn) % 3:
                    done.append(("delivered", a, first, at))
                    break
                last, at = at, at + 10 * 2 ** (a - 1)
            else:
                done.append(("dead", 5, first, last))
        state, numbers = 0, {}
        order = sorted((done[p][3], turn, p) for p, turn in enumerate(sorted(own)) if done[p][0] == "delivered")
        for n, (_, turn, p) in enumerate(order, 1):
            state += n * turns[conv, turn][1]
            numbers[p] = n, (state + 2**63) % 2**64 - 2**63
        for p, turn in enumerate(sorted(own)):
            out[conv, turn] = done[p] + numbers.get(p, (None, None)) + (turns[conv, turn][0],)
    return out


TURNS = (
    [(1, t, f"x{t}") for t in range(-50, 300)]
    + [(2, t * 1000, None) for t in range(150)]
    + [(3, 0, "a"), (3, 0, "b"), (3, 0, "b"), (None, 1, "z"), (None, 1, "y"), (4, None, "y"), (4, 2, ""), (4, 5, "é" * 50_000)]
    + [(c, t, "q") for c in range(5, 25) for t in range(5)]
)


@pytest.mark.parametrize("sizes", [(4096, 32_768), (4, 16), (16, 7), (10, 1)])
def test_release(spark, sizes):
    rows = spark.createDataFrame([(c, t, "u", x, 1, "s") for c, t, x in TURNS], "conv_id long, turn long, role string, text string, p long, status string").repartition(5)
    got = {(r.conv_id, r.turn): (r.status, r.attempts, r.first_at, r.last_at, r.release_no, r.state, r.copies) for r in release.replay(rows, *sizes).collect()}
    assert got == replayed(TURNS)


def test_release_of_nothing(spark):
    assert release.replay(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_state_wraps(spark):
    """Beyond 64 bits, in one piece and in several."""
    big = [-(2**63) - 5, 2**64 * 3 + 7, 2**63, -1, 2**63 - 1]
    rows = spark.createDataFrame([(str(x),) for x in big], "x string").select(release._wrap(F.col("x").cast("decimal(38,0)")).alias("y")).collect()
    want = [(x + 2**63) % 2**64 - 2**63 for x in big]
    assert [r.y for r in rows] == want
    sums = ", ".join(f"({x})" for x in big if x >= 0)
    assert [r[0] for r in duckdb.connect().execute(f"select {release._wrapped('x')} from (values {sums}) t(x)").fetchall()] == [w for x, w in zip(big, want, strict=True) if x >= 0]


def test_running_sums(spark):
    """Levels: several keys, gaps, negative places, and a key with many cells."""
    cells = [(k, at, (at * 7 + k) % 11) for k, ats in ((1, range(-20, 500)), (2, range(0, 9000, 500)), (3, [12])) for at in ats]
    df = spark.createDataFrame(cells, "k long, at long, n long")
    got = {(r.k, r.at): int(r.before) for r in release.running(df, "k", "at", {"before": "n"}, 8).collect()}
    assert got == {(k, at): sum(n for k2, at2, n in cells if k2 == k and at2 < at) for k, at, _ in cells}


def clustered(rows):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 131072 for x in v)]
    c = [list(v) for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:8]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), k) for k, x in enumerate(c))
    for _ in range(10):
        found = [near(v)[1] for _, v in kept]
        for k in range(len(c)):
            if own := [v for (_, v), z in zip(kept, found, strict=True) if z == k]:
                c[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    of = defaultdict(int)
    for _, k, d in last:
        of[k] += d
    return sorted(((i, k, d, of[k], sum(of.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in last), key=str)


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(120).collect()]
    rows += [(9000 + i, rows[0][1]) for i in range(90)]  # a vector with much of all rows
    rows += [(None, rows[1][1]), rows[2], (rows[3][0], rows[4][1]), (7, None), (8, [1.0] * 63), (9, [math.nan] * 64), (10, [None] + [0.0] * 63), (11, [math.inf] * 64), (12, [1e30] * 64), (13, [])]
    return rows


def test_clusters(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, cluster int, weight int").repartition(3)
    assert sorted(map(tuple, lloyd.clusters(df).collect()), key=str) == clustered(vectors)
    assert lloyd.clusters(df.limit(0)).collect() == []
    few = vectors[:3]
    assert sorted(map(tuple, lloyd.clusters(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect()), key=str) == clustered(few)
    assert lloyd.clusters(spark.createDataFrame([(None, vectors[0][1])], "vec_id long, embedding array<float>")).collect() == []


def test_clusters_of_equal_vectors(spark):
    """Ties: all centroids are equal at first, the smallest takes all, the others stay."""
    rows = [(i, [0.5] * 64) for i in range(12)]
    assert sorted(map(tuple, lloyd.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str) == clustered(rows)


LINES = [
    (None, "long enough line\nx"),
    (None, "long enough line\ny"),
    (1, "LONG enough line \n\n\n"),
    (1, "Long enough line\nother line here!"),
    (2, None),
    (3, ""),
    (4, "other line here!\r\nother line here!\n"),
    (4, "other line here!\r\nother line here!\n"),
    (5, "İİİİİİİİİİİ\nééééééééé"),
    (6, "\tİİİİİİİİİİİ\x0b\nééééééééé"),
    (7, "a\n" * 5000 + "long enough line"),
    (8, "within only me\nwithin only me"),
    (-3, "other LINE here!\nonly in one document"),
    (9, "z" * 200_000),
    (10, "Z" * 200_000 + "\n" + "tail of ten"),
]


def deduplicated(rows):
    strip, none = " \t\n\x0b\x0c\r", common.NO_ID
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(none if i is None else i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(held[key(x)]) < 2 or min(held[key(x)]) == (none if i is None else i)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fan", [(1, 2), (3, 2), (8, 2), (6, 3)])
def test_lines(spark, batches, fan):
    df = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in LINES], "doc_id long, text string, n_lines long, kept int, own_doc string").repartition(4)
    got = line_runs.dedup(df, batches, fan).select("doc_id", "_n_lines", "n_dropped", "_kept")
    assert sorted(map(tuple, got.collect()), key=str) == deduplicated(LINES)


def test_lines_of_nothing(spark):
    assert line_runs.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_stay_few(spark):
    """Full levels are compacted, and no key is lost or stored twice."""
    runs = line_runs.Runs(spark, 4, 2)
    try:
        for batch in range(7):
            keys = spark.range(batch * 50, batch * 50 + 100).selectExpr("id as h1", "id % 7 as h2")
            runs.add(runs.table(runs.unseen(keys)))
        names = [n for level in runs.levels for n in level]
        held = [tuple(r) for n in names for r in spark.table(n).collect()]
        assert [len(x) for x in runs.levels] == [1, 1, 1]
        assert sorted(held) == [(i, i % 7) for i in range(400)]
        plan = spark.table(names[0]).join(spark.table(names[1]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        runs.drop()


def test_spread_join(spark):
    """One key holds most rows, another a few; a third has none."""
    rows = spark.range(9000).selectExpr("id", "if(id % 10 < 9, 1, id) as k")
    groups = rows.groupBy("k").agg(F.count("*").alias("w"))
    groups = groups.unionByName(spark.createDataFrame([(-5, 0)], "k long, w long"))
    got = common.spread_join(rows, groups, ["k"], "w", 9000)
    assert got.count() == 9000 and got.where("k = 1").select("w").distinct().collect()[0].w == 8100


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{Path(sf_dir) / t}.parquet')")
    out = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in out.description]
    want = sorted(out.fetchall(), key=str)
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == want
