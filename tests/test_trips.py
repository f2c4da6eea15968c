"""Trip files as they come: mixed layouts, fractions, quotes, bad rows, missing columns."""

from datetime import datetime
from decimal import Decimal

import pytest

from farewheel.model import RIDES
from farewheel.operators import segmentation
from farewheel.sources.trips import read_trips, write_trips


@pytest.fixture
def folder(tmp_path):
    def write(*lines):
        (tmp_path / "trips.csv").write_text("\n".join(lines) + "\n")
        return str(tmp_path)
    return write


def test_rides_schema_and_prices(spark, folder):
    path = folder(
        "Trip Id,Trip  Duration,Trip Duration,Start Station Id,Start Time,Stop Time,User Type,Bike Id,Model,Start Station Name",
        '1,x,743,7001,01/05/2023 08:30,01/05/2023 08:42,Casual Member,901,ICONIC,"Queen St, at ""Bay"""',
        "2,x,743,7001.0,2023-01-05 09:30:15,2023-01-05 09:42:38,Annual Member,902,EFIT,A",
        "3,x,n/a,,1/5/2023 9:05,,Casual Member,903,,A",
        ",x,100,7001,01/05/2023 08:30,01/05/2023 08:42,Casual Member,901,ICONIC,no id",
        "5,x,100,7001,soon,01/05/2023 08:42,Casual Member,901,ICONIC,no start",
    )
    bikes = spark.createDataFrame([("903", "EFIT")], "bike_id string, bike_type string")
    riders = spark.createDataFrame([("1", 11)], "ride_id string, user_id long")
    trips = read_trips(spark, path, bikes, riders)
    assert [(f.name, f.dataType) for f in trips.schema] == [(f.name, f.dataType) for f in RIDES]
    rows = {r.ride_id: r for r in trips.collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["1"].duration_min == 743 / 60 and rows["1"].ride_cost_cad == Decimal("2.49") and rows["1"].user_id == 11
    assert rows["1"].started_at == datetime(2023, 1, 5, 8, 30) and rows["1"].station_id == 7001
    assert rows["2"].ride_cost_cad == Decimal("1.24") and rows["2"].started_at.second == 15 and rows["2"].station_id == 7001
    assert rows["3"].bike_type == "EFIT" and rows["3"].duration_min is None and rows["3"].ride_cost_cad is None
    assert rows["3"].started_at == datetime(2023, 1, 5, 9, 5) and rows["3"].ended_at is None


def test_missing_columns_are_null(spark, folder):
    rows = read_trips(spark, folder("Start Time,Trip Id", "2023-03-01 10:00,a")).collect()
    assert [(r.ride_id, r.user_type, r.duration_min, r.user_id) for r in rows] == [("a", None, None, None)]


def test_trips_feed_an_operator(spark, build, tmp_path):
    rides = build.rides(*[(5, f"2023-12-{d:02d} 08:00", 12.5, "Casual Member", "EFIT", "3.50") for d in range(4, 9)])
    write_trips(rides, str(tmp_path / "out"))
    back = read_trips(spark, str(tmp_path / "out"), riders=rides.select("ride_id", "user_id"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rides.collect()))
    tier = segmentation.tier_recommendation(back).collect()[0]
    assert (tier.user_id, tier.persona_segment, tier.weekend_tier_shown, tier.recommended_tier) == (5, "E-bike Adopter", False, "annual")
