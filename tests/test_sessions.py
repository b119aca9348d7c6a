"""Keyed state over events in shuffled batches, and where it ends."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wordloom.operators import puzzles
from wordloom.sources.tables import table
from wordloom.streaming import events as E
from wordloom.streaming import sessions as S

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def folder(spark, tmp_path, batches):
    """A folder whose table of events has one file a batch, oldest first."""
    for n, rows in enumerate(batches):
        made = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, props string")
        made.select("event_id", F.timestamp_micros("at").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), "props").select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.parquet(f"{tmp_path}/part{n}")
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        part = next((tmp_path / f"part{n}").glob("*.parquet"))
        part.rename(tmp_path / "events.parquet" / f"{n}.parquet")
        time.sleep(0.02)
        (tmp_path / "events.parquet" / f"{n}.parquet").touch()
    return str(tmp_path)


def run(spark, d, plan, keys):
    found = S._with_rocks(spark, lambda: E.streamed(spark, d, plan, keys, files_per_batch=1).collect())
    return sorted(map(repr, (tuple(r) for r in found)))


HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Events of ten days, each later than those of its batch by up to a day."""
    rng = random.Random(6)
    rows = [(k, (24 + rng.randrange(240)) * HOUR, rng.randrange(4), rng.choice(["error", "error", "purchase", "signup", "view", "click"]), rng.choice(['{"k": %d}' % rng.randrange(5), "{}"])) for k in range(400)]
    rows.sort(key=lambda r: r[1] + rng.randrange(24) * HOUR)
    return folder(spark, tmp_path_factory.mktemp("events"), [rows[k : k + 60] for k in range(0, len(rows), 60)])


def test_marks_of_shuffled_batches(spark, shuffled):
    want = sorted(map(repr, (tuple(r) for r in E.rung_marks(table(spark, shuffled, "events")).collect())))
    assert run(spark, shuffled, S.rung_marks, ["event_id"]) == want and len(want) > 100


def test_walks_of_shuffled_batches(spark, shuffled):
    want = sorted(map(repr, (tuple(r) for r in puzzles.session_walk(spark, shuffled).collect())))
    assert run(spark, shuffled, S.session_walk, ["user_id"]) == want and len(want) == 4


def test_state_ends(spark, tmp_path):
    day = 24 * HOUR
    batches = [[(1, 1, 1, "error", "{}"), (2, HOUR, 2, "error", "{}")], [(3, 20 * day, 2, "view", "{}"), (4, 20 * day, 2, "purchase", "{}")], [(5, 20 * day, 3, "signup", "{}")], [(6, 21 * day, 1, "purchase", '{"k": 3}'), (7, HOUR, 1, "error", "{}")]]
    d = folder(spark, tmp_path, batches)
    assert run(spark, d, lambda e: S.rung_marks(e, idle_days=90), ["event_id"]) == ["(4, 2, 'retry')", "(5, 3, 'revealed')", "(6, 1, 'retry')"]
    assert run(spark, d, lambda e: S.rung_marks(e, idle_days=5), ["event_id"]) == ["(4, 2, 'retry')", "(5, 3, 'revealed')", "(6, 1, 'first')"]
    assert run(spark, d, S.session_walk, ["user_id"])[0] == "(1, '1970-01-22', 1, 0, 3, True)"
