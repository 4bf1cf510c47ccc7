from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.session import build_session

# The published monthly champagne sales series, 1964-01 to 1972-09.
CHAMPAGNE = [
    2815, 2672, 2755, 2721, 2946, 3036, 2282, 2212, 2922, 4301, 5764, 7312,
    2541, 2475, 3031, 3266, 3776, 3230, 3028, 1759, 3595, 4474, 6838, 8357,
    3113, 3006, 4047, 3523, 3937, 3986, 3260, 1573, 3528, 5211, 7614, 9254,
    5375, 3088, 3718, 4514, 4520, 4539, 3663, 1643, 4739, 5428, 8314, 10651,
    3633, 4292, 4154, 4121, 4647, 4753, 3965, 1723, 5048, 6922, 9858, 11331,
    4016, 3957, 4510, 4276, 4968, 4677, 3523, 1821, 5222, 6872, 10803, 13916,
    2639, 2899, 3370, 3740, 2927, 3986, 4217, 1738, 5221, 6424, 9842, 13076,
    3934, 3162, 4286, 4676, 5010, 4874, 4633, 1659, 5951, 6981, 9851, 12670,
    4348, 3564, 4577, 4788, 4618, 5312, 4298, 1413, 5877,
]


def month(i: int, start: tuple[int, int] = (1964, 1)) -> dt.date:
    n = start[0] * 12 + start[1] - 1 + i
    return dt.date(n // 12, n % 12 + 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]", "tidemill-tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def raw_lines() -> list[tuple[str | None, str | None]]:
    """The series as read from its file, with an empty and a free-text footer row."""
    rows = [(month(i).strftime("%Y-%m"), str(v)) for i, v in enumerate(CHAMPAGNE)]
    return [*rows, (None, None), ("monthly champagne sales ?64-?72", None)]


@pytest.fixture(scope="session")
def raw(spark, raw_lines):
    return spark.createDataFrame(raw_lines, "Year_Month string, Sales string").cache()


@pytest.fixture(scope="session")
def series(spark):
    return spark.createDataFrame([(month(i), float(v)) for i, v in enumerate(CHAMPAGNE)], "ts date, y double").cache()


@pytest.fixture(scope="session")
def panel(spark, series):
    """Two keys with different spans and levels."""
    other = series.where(F.col("ts") >= "1966-01-01").withColumn("y", F.col("y") * 10 + 7)
    return (
        series.withColumn("k", F.lit("a")).unionByName(other.withColumn("k", F.lit("b"))).select("k", "ts", "y").cache()
    )


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
