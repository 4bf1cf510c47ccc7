"""How often the final plans read their table, and the gaps between times beside brute force."""

from __future__ import annotations

import datetime as dt
import os
import random
import re
from collections import Counter

import pytest

from tidemill.functions.ordered import gap_counts, gap_days
from tidemill.operators import profile
from tidemill.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize(("name", "scans"), [("detect_frequency", 1), ("summary", 2), ("distribution_stats", 2)])
def test_profiles_read_their_table_few_times(spark, name, scans):
    # a summary's first read, of moments and sketch together, is kept when the plan is built
    assert final_plan(QUERIES[name](spark, SF)).count("FileScan") <= scans


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_frequency_shuffles_reduced_rows_only(spark):
    plan = final_plan(QUERIES["detect_frequency"](spark, SF))
    assert len(re.findall(r"(?<!Reused)Exchange", plan)) <= 4 and "Join" not in plan


@pytest.mark.parametrize("block", ["year", "month", "day", "hour"])
def test_gaps_equal_brute_force(spark, block):
    rng = random.Random(3)
    start = dt.datetime(2023, 11, 20)
    rows = [(k, start + dt.timedelta(minutes=rng.choice([30, 60, 1440]) * rng.randrange(90))) for k in ("hot", "hot", "hot", "b", None) for _ in range(70)]
    rows += [("one", start)] * 3 + [("none", None)] * 2 + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    want, sizes = Counter(), Counter()
    for k in {k for k, _ in rows}:
        times = sorted({t for key, t in rows if key == k and t is not None})
        want.update((k, int((b - a).total_seconds())) for a, b in zip(times, times[1:]))
        sizes[k] = sum(1 for key, t in rows if key == k and t is not None)
    got = gap_days(df, ["k"], "ts", block).collect()
    assert {(r.k, r.seconds): r.n for r in got} == dict(want) and all(r.days == r.seconds // 86400 for r in got)
    counted = Counter()
    for r in gap_counts(df, ["k"], "ts", block).collect():
        counted[r.k] += r.n_obs
    assert counted == sizes
    found = {r.k: (r.n_obs, r.frequency) for r in profile.detect_frequency(df, ["k"], "ts", block).collect()}
    assert found["one"] == (3, "M") and found["none"] == (0, "M") and found["hot"][0] == 210
    whole = profile.detect_frequency(df, [], "ts", block).collect()
    assert len(whole) == 1 and whole[0].n_obs == len(rows) - 3
