"""Weather labels, classification rules and the regressor encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WMO weather-code groups used for the daylight classification.
SUNNY_CODES = [0, 1, 2]
CLOUDY_CODES = [3, 45, 48, 51, 53, 55]
THUNDER_CODES = [95, 96, 99]
DAYLIGHT_FIRST_HOUR, DAYLIGHT_LAST_HOUR = 7, 19
DRY_PRECIP_MM = 2.5

# Forecast-service condition groups.
CLEAR_MAINS = ["clear"]
CLOUDY_MAINS = ["clouds", "mist", "haze", "fog", "drizzle"]
RAIN_MAINS = ["rain", "squall", "tornado"]
THUNDER_MAINS = ["thunderstorm"]
BUSINESS_FIRST_HOUR, BUSINESS_LAST_HOUR = 9, 21

# Weather regressor weights (unknown label → 0).
WEATHER_WEIGHTS = {"Fair / Sunny": 1.1, "Sunny": 1.1, "Cloudy": 1.0, "Raining": 0.7, "Thunderstorm": 0.4}

SUNNY_LABEL = "Fair / Sunny"
DEFAULT_CONDITION = "Cloudy"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_forecast_condition(main) -> Column:
    """Forecast-service 'main' condition → our five labels (other → Cloudy)."""
    m = F.lower(_c(main))
    return (F.when(m.isin(*CLEAR_MAINS), F.lit(SUNNY_LABEL))
            .when(m.isin(*CLOUDY_MAINS), F.lit("Cloudy"))
            .when(m.isin(*RAIN_MAINS), F.lit("Raining"))
            .when(m.isin(*THUNDER_MAINS), F.lit("Thunderstorm"))
            .otherwise(F.lit(DEFAULT_CONDITION)))


def daylight_aggregates(code, precip):
    """Partial aggregates for the daylight classification (use in ``agg``)."""
    code, precip = _c(code), _c(precip)
    return [
        F.sum(precip.cast("decimal(18,3)")).alias("precip_mm"),
        F.count(F.when(code.isin(*SUNNY_CODES), 1)).alias("sunny_n"),
        F.count(F.when(code.isin(*CLOUDY_CODES), 1)).alias("cloudy_n"),
        F.count(F.when(code.isin(*THUNDER_CODES), 1)).alias("thunder_n"),
    ]


def classify_daylight(precip_mm="precip_mm", sunny_n="sunny_n", cloudy_n="cloudy_n",
                      thunder_n="thunder_n") -> Column:
    """Dry day (< 2.5 mm): more cloudy than sunny codes → Cloudy, else Fair /
    Sunny (a tie is sunny). Wet day: any thunder code → Thunderstorm, else Raining."""
    return (F.when(_c(precip_mm) < DRY_PRECIP_MM,
                   F.when(_c(cloudy_n) > _c(sunny_n), F.lit("Cloudy")).otherwise(F.lit(SUNNY_LABEL)))
            .when(_c(thunder_n) > 0, F.lit("Thunderstorm"))
            .otherwise(F.lit("Raining")))


def unify_label(c) -> Column:
    """'Fair / Sunny' → 'Sunny' (report/payload spelling)."""
    return F.when(_c(c) == SUNNY_LABEL, F.lit("Sunny")).otherwise(_c(c))


def encode_weather(c) -> Column:
    """Weather label → regressor weight; unknown or NULL → 0."""
    m = F.create_map(*[x for k, v in WEATHER_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _c(c)), F.lit(0.0))


def rain_level(avg_pop) -> Column:
    return (F.when(_c(avg_pop) <= 30, F.lit("Light"))
            .when(_c(avg_pop) <= 70, F.lit("Medium"))
            .otherwise(F.lit("Heavy")))
