"""Windows over keys that hold most rows, against the plain window over the whole key."""

import random
import subprocess
import sys
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.operators import metrics as M

SCHEMA = "id int, k string, ts int, v double, _range string"


def rows(n=900, seed=1):
    r = random.Random(seed)
    return [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, r.randint(0, 80)]) if i % 50 == 0 else r.randint(0, 80), None if i % 17 == 0 else float(r.randint(0, 9)), "") for i in range(n)]


def test_blocks_and_ranges_equal_the_plain_window(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 40)
    df = spark.createDataFrame(rows(), SCHEMA).drop("_range")
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = {r.id: (r.p, r.m) for r in df.select("id", (F.row_number().over(w) - 1).alias("p"), F.avg("v").over(w.rowsBetween(-9, 0)).alias("m")).collect()}
    got = {r.id: (r._pos, r.m) for r in M.over_last(df, "k", ["ts", "id"], 10, {"m": F.avg("v")}).collect()}
    assert got == plain
    a = {r.id: (r.recent, r.previous) for r in M.trend(df, "k", ["ts", "id"], "v").collect()}
    b = {r.id: (r.x, r.y) for r in df.select("id", F.avg("v").over(w.rowsBetween(-2, 0)).alias("x"), F.avg("v").over(w.rowsBetween(-5, -3)).alias("y")).collect()}
    assert a == b


def runs(data, state):
    out, last = {}, {}
    for i, k, _, v, _ in sorted(data, key=lambda r: (r[1] or "", r[2] is not None, r[2] or 0, r[0])):
        s = state(v)
        n = last[k][1] + 1 if k in last and last[k][0] == s else 1
        last[k] = (s, n)
        out[i] = (s, n)
    return out


def test_run_lengths(spark):
    for threshold in (4, 8, 100):
        data = rows(seed=threshold)
        got = M.run_lengths(spark.createDataFrame(data, SCHEMA).drop("_range"), "k", ["ts", "id"], F.col("v") > threshold)
        assert {r.id: (r.state, r.run) for r in got.collect()} == runs(data, lambda v: None if v is None else v > threshold)
    assert M.run_lengths(spark.createDataFrame([], SCHEMA).drop("_range"), "k", ["ts", "id"], F.col("v") > 1).count() == 0


def test_medians_and_separation(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert {r.k: r.median for r in M.medians(df, ["k"], "v").collect()} == {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    r = random.Random(3)
    v = [("a" if i % 3 else "b", [r.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [("a", [0.0] * 4)]
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    pairs = [(a == b, cos(x, y)) for i, (a, x) in enumerate(v[:-1]) for b, y in v[i + 1 : -1]]
    mean = lambda z: sum(z) / len(z)
    got = M.separation(spark.createDataFrame(v, "label string, e array<double>"), "label", "e").first().separation
    assert abs(got - (mean([c for s, c in pairs if s]) - mean([c for s, c in pairs if not s]))) < 1e-9


FRESH = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for r in entry.queries()[sys.argv[1]](spark, sys.argv[2]).collect():
    print("row", *r)
"""


def fresh(spark, tmp_path, query):
    """The rows of a query that is the first of its session, and events: there the columns' numbers begin at 0."""
    events = [(i, datetime(2024, 1, 1) + timedelta(seconds=i * 7919 % 600), i % 5, "error" if i % 3 else None, None if i % 11 == 0 else float(i * 31 % 97)) for i in range(200)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = subprocess.run([sys.executable, "-c", FRESH, query, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return [line.split()[1:] for line in out.stdout.splitlines() if line.startswith("row ")], sorted(events, key=lambda e: (e[1], e[0]))


def test_eta_first_in_a_session(spark, tmp_path):
    got, events = fresh(spark, tmp_path, "ref_W06_eta")
    want, seen = {}, {}
    for i, _, _, kind, value in events:
        seen.setdefault(kind, []).append(value)
        last = [v for v in seen[kind][-20:] if v is not None]
        want[i] = (1000 - len(seen[kind])) * sum(last) / len(last) if last else None
    assert len(got) == len(want) == 200
    for i, eta in got:
        assert eta == "None" if want[int(i)] is None else abs(float(eta) - want[int(i)]) < 1e-3


def test_run_lengths_first_in_a_session(spark, tmp_path):
    got, events = fresh(spark, tmp_path, "ref_W03_run_lengths")
    want, last = {}, {}
    for i, _, _, kind, value in events:
        if value is not None:
            slow, (before, n) = value > 40, last.get(kind, (None, 0))
            last[kind] = (slow, n + 1 if slow == before else 1)
            want[str(i)] = [str(x) for x in last[kind]]
    assert len(got) == len(want) and {i: row for i, *row in got} == want
