import os
import sys
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paths import ROOT  # noqa: E402

sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from farewheel import model  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("farewheel-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        # a zone with summer time: results must not depend on it
        .config("spark.sql.session.timeZone", "America/Toronto")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


class Build:
    """Small canonical tables from short tuples."""

    def __init__(self, spark):
        self.spark = spark

    def rides(self, *rows):
        """(user, start[, minutes, user_type, bike, cost])"""
        out = []
        for i, row in enumerate(rows):
            user, start, minutes, kind, bike, cost = (*row, *(10.0, "Casual Member", "ICONIC", "2.20")[len(row) - 2:])
            begin = at(start)
            out.append((f"r{i}", user, begin, begin + timedelta(minutes=minutes), float(minutes), kind, bike, 1, Decimal(cost)))
        return self.spark.createDataFrame(out, model.RIDES)

    def events(self, *rows):
        """(user, type, time[, channel, variant, metadata, tier])"""
        out = []
        for i, row in enumerate(rows):
            user, kind, when, channel, variant, meta, tier = (*row, *("email", "control", None, None)[len(row) - 3:])
            out.append((f"e{i}", user, kind, at(when), tier, None, channel, variant, meta))
        return self.spark.createDataFrame(out, model.MEMBERSHIP_EVENTS)

    def users(self, *rows):
        """(user, persona[, first ride])"""
        out = [(u, at(first[0]) if first else None, None, persona, None, None) for u, persona, *first in rows]
        return self.spark.createDataFrame(out, model.USERS)

    def app_events(self, *rows):
        return self.spark.createDataFrame([(u, k, at(t)) for u, k, t in rows], model.APP_EVENTS)


@pytest.fixture(scope="session")
def build(spark):
    return Build(spark)
