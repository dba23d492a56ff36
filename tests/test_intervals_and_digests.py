"""Overlapping spans, row versions, durations that add up and digests by part, against plain Python."""

import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from folioscope.operators import durations as T
from folioscope.operators import intervals as I
from folioscope.sources import digests as G


@pytest.mark.parametrize("keys", [["k"], []])
def test_overlap_join(spark, keys):
    """Spans of all sizes around zero, one bin that holds a third of them, and odd rows."""
    rng = random.Random(4)

    def side(seed):
        rows = []
        for k in range(350):
            low = rng.choice([rng.randint(-5000, 5000), 7, rng.randint(0, 40)])
            rows.append((k, rng.choice(["a", "b", None]), low, low + rng.choice([1, 3, 20, 300, 4000, 10**6])))
        return rows + [(900, "a", None, 5), (901, "a", 5, None), (902, "a", 5, 5), (903, "a", 6, 2), (904, "a", -(10**9), 10**9), (905, "a", -17, -16), (905, "a", -17, -16)]

    left, right = side(1), side(2)
    frame = lambda rows: spark.createDataFrame(rows, "id long, k string, low long, high long").repartition(3)
    joined = I.overlap_join(frame(left), frame(right), keys, ("low", "high"), ("low", "high"), 4)
    got = sorted((r.left.id, r.right.id) for r in joined.collect())
    whole = lambda rows: [r for r in rows if r[2] is not None and r[3] is not None and r[2] < r[3]]
    want = sorted((a[0], b[0]) for a in whole(left) for b in whole(right) if a[2] < b[3] and b[2] < a[3] and (not keys or a[1] is not None and a[1] == b[1]))
    assert got == want
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert I.overlap_join(frame(left).limit(0), frame(right), keys, ("low", "high"), ("low", "high")).count() == 0


def test_spans_of_times(spark):
    df = spark.sql("select * from values (1, timestamp_ntz '2024-01-01 00:00:00', timestamp_ntz '2024-01-03 00:00:00'), (2, timestamp_ntz '2024-01-02 23:59:59', timestamp_ntz '2024-02-01 00:00:00'), (3, timestamp_ntz '2024-01-03 00:00:00', timestamp_ntz '2024-01-03 00:00:01') t(id, a, b)")
    assert sorted((r.left.id, r.right.id) for r in I.overlap_join(df, df, [], ("a", "b"), ("a", "b")).where("left.id < right.id").collect()) == [(1, 2), (2, 3)]


@pytest.fixture
def names(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["hot", "hot", "x", "y", "z"]), f"n{k}", f"2024-01-{rng.randint(1, 9):02d} {rng.randint(0, 3):02d}:00:00", rng.random() < 0.1) for k in range(200)]
    rows += [(900, None, "no", "2024-01-01 00:00:00", False), (901, "x", "no", None, False)]
    return spark.createDataFrame(rows, "seq long, user string, name string, at string, gone boolean").withColumn("at", F.col("at").cast("timestamp_ntz")).repartition(4)


def ordered(names):
    rows = sorted((r for r in names.collect() if r.user and r["at"]), key=lambda r: (r.user, r["at"], r.seq))
    return [(r, rows[k + 1]["at"] if k + 1 < len(rows) and rows[k + 1].user == r.user else None) for k, r in enumerate(rows)]


def test_history(names):
    got = {r.seq: r.valid_to for r in I.history(names, ["user"], "at", "seq").collect()}
    assert got == {r.seq: end for r, end in ordered(names)}


def test_as_of(names):
    for day in (1, 4, 20):
        instant = f"timestamp_ntz '2024-01-{day:02d} 01:00:00'"
        want = {}
        for r, _ in ordered(names):
            if r["at"].day < day or (r["at"].day == day and r["at"].hour <= 1):
                want[r.user] = r
        got = {r.user: r.name for r in I.as_of(names.where("user is not null"), ["user"], "at", "seq", F.expr(instant), "gone").collect()}
        assert got == {u: r.name for u, r in want.items() if not r.gone}


def test_relations_over_renames(spark, names):
    rng = random.Random(5)
    facts = [(k, rng.choice(["hot", "x", "q", None]), f"2024-01-{rng.randint(1, 12):02d} {rng.randint(0, 4):02d}:00:00") for k in range(150)] + [(500, "x", None)]
    df = spark.createDataFrame(facts, "id long, user string, time string").withColumn("time", F.col("time").cast("timestamp_ntz")).repartition(3)
    got = {r.fact.id: r.version and r.version.name for r in I.joined_as_of(df, names, ["user"], "time", "at", "seq").collect()}
    want = {}
    for r in df.collect():
        held = [v.name for v, end in ordered(names) if r.time and v.user == r.user and v["at"] <= r.time and (end is None or r.time < end)]
        want[r.id] = held[0] if held else None
    assert got == want and len(set(got.values())) > 10


@pytest.mark.parametrize("accuracy", [0.01, 0.05])
def test_durations_add_up(spark, accuracy):
    """Quantiles of merged days are within the accuracy of the exact ones; merging in any way gives the same."""
    rng = random.Random(6)
    rows = [(k % 11, rng.choice("ab"), rng.choice([0.0, rng.random(), rng.lognormvariate(2, 3), 1e-9, 3e7])) for k in range(4000)]
    odd = [(1, "a", None), (1, "a", math.nan), (1, "a", math.inf), (2, "a", -1.0), (3, "c", None)]
    events = spark.createDataFrame(rows + odd, "day int, stage string, s double").repartition(5)
    daily = T.sketch(events, ["day", "stage"], "s", accuracy)
    shares = [0.0, 0.5, 0.9, 0.999, 1.0]
    got = {r.stage: r for r in T.quantiles(daily, ["stage"], shares, accuracy).collect()}
    for stage in "ab":
        exact = sorted(x for _, s, x in rows if s == stage)
        assert got[stage].n == len(exact)
        for k, share in enumerate(shares, 1):
            true = exact[math.floor(share * (len(exact) - 1))]
            assert abs(got[stage][f"q{k}"] - true) <= accuracy * true * (1 + 1e-9)
    assert got["a"].n_unusable == 4 and got["c"].n == 0 and got["c"].q2 is None
    weekly = T.merged(daily.withColumn("week", F.expr("day div 7")), ["week", "stage"])
    once = T.quantiles(T.sketch(events, ["stage"], "s", accuracy), ["stage"], shares, accuracy)
    assert sorted(T.quantiles(weekly, ["stage"], shares, accuracy).collect()) == sorted(once.collect())
    assert daily.count() < 4000 and T.quantiles(daily.limit(0), ["stage"], shares).count() == 0
    with pytest.raises(ValueError):
        T.sketch(events, ["day"], "s", 1.0)


def test_one_changed_row_names_one_part(spark):
    rows = [(k, f"t{k}") for k in range(2000)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, t string")
    parts = 300
    tree = lambda rows: G.digest_tree(frame(rows), "id", parts)
    part = lambda k: spark.range(1).select(G.part_of(F.lit(k).cast("long"), parts)).first()[0]
    base = tree(rows)
    assert G.differing_parts(base, tree(rows[::-1]), parts) == []
    assert G.differing_parts(base, tree([(k, t + "!" * (k == 77)) for k, t in rows]), parts) == [part(77)]
    assert G.differing_parts(base, tree(rows[1:] + [(5000, "new")]), parts) == sorted({part(0), part(5000)})
    assert G.differing_parts(base, tree(rows + [rows[3], rows[3]]), parts) == [part(3)]  # twice cancels out of the xor alone
    root = base.where("level = 0").collect()
    assert len(root) == 1 and root[0].n == 2000 and tree([]).count() == 0 and len(G.differing_parts(base, tree([]), parts)) == base.where("level = 3").count()


def test_repair_reads_the_parts_that_differ(spark, tmp_path):
    rows = [(k, f"t{k}" if k % 9 else None) for k in range(500)] + [(None, "no key")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, t string")
    path = str(tmp_path / "backup")
    G.backup_parts(frame(rows), path, "id", 64)
    assert G.damaged_parts(spark, path, frame(rows).schema, "id", 64) == []
    other = str(tmp_path / "other")
    shutil.copytree(path, other)
    ours = frame([(k, "x" if k in (5, 6) else t) for k, t in rows if k != 7])
    unlike = G.repaired(ours, other, "id", 64)[1]
    assert len(unlike) in (1, 2, 3)
    for file in (tmp_path / "other" / "rows").glob("_part=*/*.parquet"):
        if int(file.parent.name.removeprefix("_part=")) not in unlike:
            file.write_bytes(b"not read")
    whole, again = G.repaired(ours, other, "id", 64)
    assert again == unlike and sorted(whole.collect(), key=str) == sorted(frame(rows).collect(), key=str)
    same, none = G.repaired(frame(rows), path, "id", 64)
    assert none == [] and same.count() == 501
    part = spark.range(1).select(G.part_of(F.lit(5).cast("long"), 64)).first()[0]
    frame([(5, "bad")]).write.mode("append").parquet(f"{path}/rows/_part={part}")
    assert G.damaged_parts(spark, path, frame(rows).schema, "id", 64) == [part]
    with pytest.raises(ValueError, match="damaged"):
        G.repaired(frame([(k, t) for k, t in rows if k != 5]), path, "id", 64)
