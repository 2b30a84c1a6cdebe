"""Entity schemas and closed vocabularies.

A missing measurement is NULL and never zero; a detection count of zero is a true zero.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The closed vocabularies of the domain, stored as plain strings.
EVENTS = ("lluvia_intensa", "sequia", "incendio")
LEVELS = ("bajo", "medio", "alto")
ALGORITHMS = ("linea_base_climatologica", "regresion_logistica", "random_forest", "xgboost")
IMPUTATION_METHODS = (
    "sin_imputar",
    "interpolacion_lineal",
    "media_movil",
    "climatologia_mensual",
)

# Source parameter -> our column, and the unit each must declare.
REANALYSIS_COLUMNS = {
    "T2M_MAX": "temp_max_c",
    "T2M_MIN": "temp_min_c",
    "T2M": "temp_mean_c",
    "RH2M": "humidity_pct",
    "WS2M": "wind_ms",
    "ALLSKY_SFC_SW_DWN": "radiation_mj_m2",
}
REANALYSIS_UNITS = {
    "T2M_MAX": "C",
    "T2M_MIN": "C",
    "T2M": "C",
    "RH2M": "%",
    "WS2M": "m/s",
    "ALLSKY_SFC_SW_DWN": "MJ/m^2/day",
}
DEFAULT_FILL = -999.0

# Known meshes as (step in longitude, step in latitude, anchor).
MESHES = {
    "power": (0.625, 0.5, "centre"),
    "chirps": (0.05, 0.05, "edge"),
    "era5-land": (0.1, 0.1, "centre"),
}

MEASURES = (
    "temp_max_c",
    "temp_min_c",
    "temp_mean_c",
    "humidity_pct",
    "wind_ms",
    "radiation_mj_m2",
    "precip_mm",
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _D, _I, _H = T.StringType(), T.DoubleType(), T.IntegerType(), T.ShortType()

POINT = _struct(("lon", _D), ("lat", _D))
MULTIPOLYGON = T.ArrayType(T.ArrayType(T.ArrayType(POINT)))

PROVINCE = _struct(("code", _H), ("name", _S))
CANTON = _struct(("code", _H), ("province_code", _H), ("name", _S), ("geometry", MULTIPOLYGON))
DISTRICT = _struct(
    ("code", _S),
    ("canton_code", _H),
    ("name", _S),
    ("area_km2", T.DecimalType(12, 4)),
    ("population", _I),
    ("geometry", MULTIPOLYGON),
)
SOURCE = _struct(("code", _S), ("name", _S), ("resolution", _S), ("description", _S))
MEASUREMENT = _struct(
    ("district", _S),
    ("date", T.DateType()),
    *((name, _D) for name in MEASURES),
    ("rain_source", _S),
    ("other_source", _S),
    ("imputed", T.BooleanType()),
    ("imputation_method", _S),
    ("downloaded_at", T.TimestampType()),
)
DERIVED_INDEX = _struct(
    ("district", _S),
    ("date", T.DateType()),
    ("spi_1m", _D),
    ("spi_3m", _D),
    ("temp_anomaly", _D),
    ("dry_days", _I),
)
HOT_SPOT = _struct(
    ("date", T.DateType()),
    ("lat", _D),
    ("lon", _D),
    ("confidence", _I),
    ("brightness_k", _D),
    ("satellite", _S),
    ("district", _S),
)
EXPLANATION = T.ArrayType(_struct(("variable", _S), ("contribution", _D)))
RISK = _struct(
    ("district", _S),
    ("date", T.DateType()),
    ("event", _S),
    ("level", _S),
    ("probability", _D),
    ("algorithm", _S),
    ("model_version", _S),
    ("explanation", EXPLANATION),
)
HISTORICAL_EVENT = _struct(
    ("district", _S),
    ("event", _S),
    ("start_date", T.DateType()),
    ("end_date", T.DateType()),
    ("severity", _S),
    ("source", _S),
    ("description", _S),
)
SERIES_EXPORT = _struct(
    ("district", _S),
    ("variable", _S),
    ("unit", _S),
    ("points", T.ArrayType(_struct(("date", T.DateType()), ("value", _D)))),
)
QUALITY_REPORT = _struct(
    ("source", _S),
    ("variable", _S),
    ("period_start", T.DateType()),
    ("period_end", T.DateType()),
    ("expected", T.LongType()),
    ("present", T.LongType()),
    ("pct_missing", _D),
    ("imputation_method", _S),
    ("notes", _S),
)
MODEL_METRICS = _struct(
    ("algorithm", _S),
    ("event", _S),
    ("version", _S),
    ("trained_at", T.TimestampType()),
    ("macro_f1", _D),
    ("macro_precision", _D),
    ("macro_recall", _D),
    ("confusion", T.ArrayType(T.ArrayType(T.LongType()))),
    ("beats_baseline", T.BooleanType()),
)

# The key of each entity: what an upsert replaces and what must be unique.
KEYS = {
    "province": ("code",),
    "canton": ("code",),
    "district": ("code",),
    "source": ("code",),
    "measurement": ("district", "date"),
    "derived_index": ("district", "date"),
    "hot_spot": ("date", "lat", "lon", "satellite"),
    "risk": ("district", "date", "event"),
    "quality_report": ("source", "variable", "period_start", "period_end"),
    "model_metrics": ("algorithm", "event", "version"),
}


def conformance(df, schema: T.StructType) -> list[str]:
    """Differences between a table and a declared record shape, as readable lines."""
    have = {f.name: f.dataType for f in df.schema}
    found = []
    for field in schema:
        if field.name not in have:
            found.append(f"missing column {field.name}")
        elif have[field.name].simpleString() != field.dataType.simpleString():
            found.append(
                f"{field.name}: {have[field.name].simpleString()} instead of "
                f"{field.dataType.simpleString()}"
            )
    return found
