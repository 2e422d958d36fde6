import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewright.plans import folders, monthly
from tidewright.sources import files, grids

D = dt.date


@pytest.fixture
def data(tmp_path):
    def put(place, name, text):
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / place / name).write_text(text)

    put("interim", "conductivity_MyTho_monthly_clean.csv", "date,note,conductivity_mS_per_m,station\n" + "".join(f"2001-{m:02d}-15,x,{m * 10},MyTho\n" for m in range(1, 13)))
    put("interim", "conductivity_TanChau_monthly_clean.csv", "station,date,conductivity_mS_per_m\nTanChau,2001-02-03,5\nTanChau,2001-02-09,7\n")
    meteo = files.METEO.replace(" string", "").replace(" double", "").replace(" date,", ",").replace(", ", ",").replace("station,date date", "station,date")
    put("raw/openmeteo_rainfall", "openmeteo_MyTho_daily.csv", f"{meteo}\nMyTho,2001-01-01,1.5,20,30,10,1,2,80,5\nMyTho,2001-01-02,2.5,22,33,9,1,4,90,5\n")
    put("raw/openmeteo_rainfall", "openmeteo_all_stations_daily.csv", f"{meteo}\nMyTho,2001-01-01,100,20,30,10,1,2,80,5\n")
    put("raw/waterlevel", "dahiti_waterlevel_MyTho_id3316.csv", "﻿station,dahiti_id,target_name,target_lat,target_lon,water_level_m,water_level_err_m,date\nMyTho,3316,,,,1.5,0.1,2001-01-05 10:00:00\nMyTho,3316,,,,2.5,0.1,2001-01-25\n")
    put("raw/waterlevel/glofas_tanchau", "glofas_bad.nc", "no grid")
    for k, (first, last) in enumerate(((1, 7), (7, 13))):
        times = [dt.datetime(2001, m, d) for m in range(first, last) for d in (1, 2) for _ in range(2)]
        values = [float(t.month + c) for t, c in zip(times, [0, 1] * (len(times) // 2), strict=True)]
        pq.write_table(pa.table({"time": pa.array(times, pa.timestamp("us")), "lat": [0.0, 1.0] * (len(times) // 2), "dis24": values}), tmp_path / "raw/waterlevel/glofas_tanchau" / f"glofas_{k}.nc")
    return tmp_path


def test_master_of_a_folder(spark, data):
    df = folders.master(spark, str(data), opener=grids.CellFile)
    assert df.columns == [*monthly.KEYS, *monthly.MEASURES]
    rows = {(r.station, r.month_start.month): r for r in df.collect()}
    assert len(rows) == 24 and rows["TanChau", 2].conductivity_mS_per_m == 6.0 and rows["TanChau", 2].glofas_discharge_m3s == 2.5
    r = rows["MyTho", 1]
    assert (r.conductivity_mS_per_m, r.precipitation_sum, r.temperature_mean, r.temperature_max, r.temperature_min, r.windspeed_mean, r.water_level_m) == (10.0, 4.0, 21.0, 33.0, 9.0, 3.0, 2.0)
    assert rows["MyTho", 2].precipitation_sum is None and r.glofas_discharge_m3s is None
    folders.save(df, str(data / "processed"), folders.MASTER, monthly.KEYS)
    text = (data / "processed" / "master_timeseries.csv").read_text().splitlines()
    assert text[0] == ",".join(df.columns) and len(text) == 25 and text[1].startswith("MyTho,2001-01-01,10.0,4.0,21.0,")
    assert sorted(map(str, spark.read.parquet(str(data / "processed" / "master_timeseries.parquet")).collect())) == sorted(map(str, df.collect()))


def test_features_of_a_folder(spark, data):
    df = folders.features(spark, str(data), opener=grids.CellFile)
    rows = df.collect()
    assert [r.date for r in rows] == [D(2001, m, 1) for m in range(3, 13)]
    assert [(r.TanChau_Discharge, r.MyTho_EC, r.TanChau_Discharge_lag_2, r.MyTho_Salinity_lag_1, r.Month) for r in rows[:2]] == [(3.5, 30.0, 1.5, 20 * 0.64, 3), (4.5, 40.0, 2.5, 30 * 0.64, 4)]
    folders.save(df, str(data / "processed"), folders.FEATURES, ["date"], parquet=False)
    again = files.read_csv(spark, str(data / "processed"), "ml_*.csv", df.schema)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_missing_sources(spark, tmp_path):
    df = folders.master(spark, str(tmp_path))
    assert df.count() == 0 and df.columns == [*monthly.KEYS, *monthly.MEASURES]
    (tmp_path / "interim").mkdir()
    (tmp_path / "interim" / "conductivity_A_monthly_clean.csv").write_text("date,conductivity_mS_per_m,station\n2001-01-02,1,A\n")
    rows = folders.master(spark, str(tmp_path)).collect()
    assert [(r.station, r.conductivity_mS_per_m, r.water_level_m) for r in rows] == [("A", 1.0, None)]
    with pytest.raises(FileNotFoundError):
        folders.features(spark, str(tmp_path), "B")
