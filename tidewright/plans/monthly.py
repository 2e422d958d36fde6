"""The two pipelines: the master table of all sources, and the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import outer_align, union_align
from ..operators.features import add_lags, add_month, drop_incomplete, sorted_rows, unit_convert
from ..operators.rollup import MONTH, mean_of_means, monthly_rollup, spatial_mean

KEYS = ["station", MONTH]
METEO_SPEC = {
    "precipitation_sum": ("precipitation_sum", "sum"), "temperature_mean": ("temperature_2m_mean", "mean"), "temperature_max": ("temperature_2m_max", "max"),
    "temperature_min": ("temperature_2m_min", "min"), "evapotranspiration_sum": ("et0_fao_evapotranspiration", "sum"), "windspeed_mean": ("windspeed_10m_max", "mean"),
    "humidity_mean": ("relative_humidity_2m_mean", "mean"), "shortwave_rad_sum": ("shortwave_radiation_sum", "sum"),
}
MEASURES = {c: "double" for c in ("conductivity_mS_per_m", *METEO_SPEC, "water_level_m", "glofas_discharge_m3s")}


def discharge_by_month(cells: DataFrame, station: str = "TanChau", out: str = "glofas_discharge_m3s") -> DataFrame:
    """Gridded cells (file, time, value) to monthly means: over cells, then months in a file, then files."""
    means = spatial_mean(cells.filter("time is not null"), "value", by=["file"])
    return mean_of_means(means, "file", [], "time", "value", out).select(F.lit(station).alias("station"), MONTH, out)


def master_table(conductivity: DataFrame | None = None, meteo: DataFrame | None = None, water: DataFrame | None = None, discharge: DataFrame | None = None, per_file: str | None = None, by_union: bool = False) -> DataFrame:
    """All sources rolled up to months and aligned on (station, month), sorted; an absent one gives null columns.

    With per_file (the sources' file column), files are rolled up apart, and a month in two files stays two rows.
    by_union aligns without joins; it needs one row per key and source, so it goes without per_file.
    """
    roll = lambda df, spec: monthly_rollup(df, ["station"], "date", spec, per_file)
    frames = []
    if conductivity is not None:
        frames.append(roll(conductivity, {"conductivity_mS_per_m": ("conductivity_mS_per_m", "mean")}))
    if meteo is not None:
        frames.append(roll(meteo, METEO_SPEC))
    if water is not None:
        frames.append(roll(water, {"water_level_m": ("water_level_m", "mean")}))
    if discharge is not None:
        frames.append(discharge_by_month(discharge))
    if not frames:
        raise ValueError("no source")
    if by_union:
        if per_file:
            raise ValueError("by_union needs sources that are unique on the keys")
        joined = outer_align([union_align(frames, KEYS)], KEYS, MEASURES)
    else:
        joined = outer_align(frames, KEYS, MEASURES)
    return sorted_rows(joined, *KEYS)


def feature_table(discharge: DataFrame, conductivity: DataFrame, factor: float = 0.64) -> DataFrame:
    """date, discharge, EC, salinity, their lags and the month, for months with all of them.

    discharge: date, TanChau_Discharge; conductivity: date, MyTho_EC; both monthly. Lags are taken over the aligned
    rows before incomplete ones go.
    """
    joined = outer_align([discharge, unit_convert(conductivity, "MyTho_EC", "MyTho_Salinity", factor)], ["date"])
    lagged = add_lags(joined, "date", {"TanChau_Discharge": [1, 2], "MyTho_Salinity": [1]})
    return sorted_rows(drop_incomplete(add_month(lagged, "date")), "date")
