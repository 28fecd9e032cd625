"""Humidity, radiation and thermal comfort as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = -999.0
STEFAN_BOLTZMANN = 5.67051e-8


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def magnus(celsius: Column) -> Column:
    """Saturation vapour pressure in hPa."""
    return 6.112 * F.exp(17.67 * celsius / (celsius + 243.5))


def rh_from_dew_point(t_kelvin: Column, dew_kelvin: Column) -> Column:
    return clip(100.0 * magnus(dew_kelvin - 273.15) / magnus(t_kelvin - 273.15), 0.0, 100.0)


def rh_from_mixing_ratio(t_kelvin: Column, q: Column, pressure_pa: Column) -> Column:
    eps = 287.05 / 461.5  # gas constants of dry air and of water vapour
    return clip(q * pressure_pa / (eps + q) / (magnus(t_kelvin - 273.15) * 100) * 100, 0.0, 100.0)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def sun_distance(day: Column) -> Column:
    """Correction for the distance of the sun on a day of the year."""
    b = 2 * math.pi * day / 365
    return F.sqrt(1.00011 + 0.034221 * F.cos(b) + 0.001280 * F.sin(b) + 0.000719 * F.cos(2 * b) + 0.000077 * F.sin(2 * b))


#: The moisture exponent by ten degrees of latitude, for winter, spring, summer and autumn.
MOISTURE = (
    (3.37, 2.85, 2.80, 2.64),
    (2.99, 3.02, 2.70, 2.93),
    (3.60, 3.00, 2.98, 2.93),
    (3.04, 3.11, 2.92, 2.94),
    (2.70, 2.95, 2.77, 2.71),
    (2.52, 3.07, 2.67, 2.93),
    (1.76, 2.69, 2.61, 2.61),
    (1.60, 1.67, 2.24, 2.63),
    (1.11, 1.44, 1.94, 2.02),
)


def moisture(day: Column, latitude: float) -> Column:
    row = MOISTURE[max(0, min(8, int(latitude // 10)))]
    return F.when((day > 335) | (day <= 60), row[0]).when(day <= 152, row[1]).when(day <= 244, row[2]).otherwise(row[3])


def clearness(zenith: Column, day: Column, celsius: Column, rh_fraction: Column, global_rad: Column, latitude: float, millibar: float = 1013.0) -> dict[str, Column]:
    """Clear-sky radiation i0, clearness ci, extraterrestrial radiation i0et and its ratio kt; zenith in radians."""
    d, cos = sun_distance(day), F.cos(zenith)
    m = 35.0 * cos / F.sqrt(1224.0 * cos * cos + 1.0)
    rayleigh = 1.021 - 0.084 * F.sqrt(m * (0.000949 * millibar + 0.051))
    gamma = 17.27 * celsius / (237.7 + celsius) + F.log(rh_fraction)
    dew_f = 237.7 * gamma / (17.27 - gamma) * 1.8 + 32
    water = 1 - 0.077 * F.pow(F.exp(0.1133 - F.log(moisture(day, latitude) + 1.0) + 0.0393 * dew_f) * m, 0.3)
    raw = 1370.0 * cos * rayleigh * water * d * F.pow(F.lit(0.935), m)
    i0 = F.when(F.abs(zenith) > math.pi / 2, 0.0).otherwise(F.coalesce(F.nanvl(raw, F.lit(0.0)), F.lit(0.0)))
    corr = 0.1473 * F.log(90 - F.degrees(zenith)) + 0.3454
    i0et = 1370.0 * cos * d
    return {"i0": i0, "ci": F.try_divide(global_rad, i0) + (1 - corr), "kt": F.try_divide(global_rad, i0et), "i0et": i0et}


def diffuse(global_rad: Column, altitude: Column, kt: Column, celsius: Column, rh: Column) -> tuple[Column, Column]:
    """Direct and diffuse parts of global radiation; temperature or humidity that is missing uses the simpler rule. Altitude in degrees."""
    s, h = F.sin(F.radians(altitude)), rh / 100
    missing = celsius.isNull() | rh.isNull() | (celsius <= MISSING) | (rh <= MISSING)
    low, mid = kt <= 0.3, kt < 0.78
    plain = F.when(low, 1.020 - 0.248 * kt).when(mid, 1.45 - 1.67 * kt).otherwise(0.147)
    full = (
        F.when(low, 1 - 0.232 * kt + 0.0239 * s - 0.000682 * celsius + 0.0195 * h)
        .when(mid, 1.329 - 1.716 * kt + 0.267 * s - 0.00357 * celsius + 0.106 * h)
        .otherwise(0.426 * kt - 0.256 * s + 0.00349 * celsius + 0.0734 * h)
    )
    rad_d = global_rad * F.when(missing, plain).otherwise(full)
    rad_i = F.greatest(F.lit(0.0), (global_rad - rad_d) / s)
    return F.when((altitude < 1) & (rad_i > global_rad), global_rad).otherwise(rad_i), F.least(rad_d, global_rad)


def day_length(day: Column, latitude: float) -> dict[str, Column]:
    """Hours of daylight, declination in degrees, sunrise and sunset."""
    dec = -23.45 * F.cos(2.0 * math.pi * (day + 10.0) / 365.0)
    soc = clip(F.tan(F.radians(dec)) * math.tan(math.radians(latitude)), -1.0, 1.0)
    hours = 12.0 + 24.0 * F.asin(soc) / math.pi
    return {"hours": hours, "declination": dec, "sunrise": 12.0 - hours / 2, "sunset": 12.0 + hours / 2}


def sky_emissivity(celsius: Column, rh: Column, elvis: float = 0.0) -> Column:
    ea = 6.107 * F.pow(F.lit(10.0), 7.5 * celsius / (237.3 + celsius)) * (rh / 100)
    w = 46.5 * (ea / (celsius + 273.15))
    return 1 - (1 + w) * F.exp(-F.sqrt(1.2 + 3.0 * w)) + elvis


def mean_radiant_temperature(absorbed: Column, absorption: float = 0.97) -> Column:
    return F.sqrt(F.sqrt(absorbed / (absorption * STEFAN_BOLTZMANN))) - 273.2


#: Powers -2 to 4 of the absolute temperature, and the logarithm's factor, of the saturation pressure of water.
SATURATION = (-2.8365744e3, -6.028076559e3, 1.954263612e1, -2.737830188e-2, 1.6261698e-5, 7.0229056e-10, -1.8680009e-13)
SATURATION_LOG = 2.7150305


def vapour_pressure_kpa(celsius: Column, rh: Column) -> Column:
    tk = celsius + 273.15
    es = SATURATION_LOG * F.log(tk)
    for i, g in enumerate(SATURATION):
        es = es + g * F.pow(tk, float(i - 2))
    return F.exp(es) * 0.01 * rh / 100.0 / 10.0


def utci(celsius: Column, rh: Column, radiant: Column, wind: Column, terms: Iterable[tuple[int, int, int, int, float]]) -> Column:
    """Thermal climate index: air temperature plus a polynomial; -999 where any input is missing (-999 or less).

    terms: (power of temperature, of wind, of radiant less air temperature, of vapour pressure, coefficient). The table of the
    published approximation has about 200 entries and is a parameter.
    """
    pa, d = vapour_pressure_kpa(celsius, rh), radiant - celsius
    total = celsius
    for a, b, c, e, k in terms:
        part = F.lit(float(k))
        for col, power in ((celsius, a), (wind, b), (d, c), (pa, e)):
            for _ in range(power):
                part = part * col
        total = total + part
    missing = (celsius <= MISSING) | (rh <= MISSING) | (wind <= MISSING) | (radiant <= MISSING)
    return F.when(missing, MISSING).otherwise(total)
