"""Units of quantities: one table (symbol, dimension, factor, shift) made from few units by rules, and conversion by joining it.

A dimension is a product of base units in the order of their names, such as "kg m2 s-3" for power, so units convert into
one another wherever their quantities agree: W/m² and kBTU/h/ft², m³/h and gal/min. Units that are not in the table (those
of currencies, for one) convert into themselves only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BTU, _FT, _LB, _GAL = 1055.05585262, 0.3048, 0.45359237, 0.003785411784
_ENERGY, _POWER, _PRESSURE, _VOLTAGE, _OHM = "kg m2 s-2", "kg m2 s-3", "kg m-1 s-2", "A-1 kg m2 s-3", "A-2 kg m2 s-3"

#: Prefixes of the decimal system.
PREFIXES = {"n": ("nano", 1e-9), "µ": ("micro", 1e-6), "m": ("milli", 1e-3), "c": ("centi", 1e-2), "d": ("deci", 1e-1), "h": ("hecto", 1e2), "k": ("kilo", 1e3), "M": ("mega", 1e6), "G": ("giga", 1e9), "T": ("tera", 1e12), "P": ("peta", 1e15)}

#: Symbol, name, dimension, factor to the base units, and the prefixes it takes.
SIMPLE = (
    ("m", "meter", "m", 1.0, "nµmcdk"), ("in", "inch", "m", 0.0254, ""), ("ft", "foot", "m", _FT, ""), ("yd", "yard", "m", 0.9144, ""), ("mile", "mile", "m", 1609.344, ""), ("acre", "acre", "m2", 4046.8564224, ""),
    ("L", "liter", "m3", 1e-3, "mhk"), ("gal", "gallon", "m3", _GAL, "k"), ("qt", "quart", "m3", _GAL / 4, ""), ("pt", "pint", "m3", _GAL / 8, ""), ("fl_oz", "fluid_ounce", "m3", _GAL / 128, ""), ("galUK", "imperial_gallon", "m3", 0.00454609, ""), ("hft³", "hecto_cubic_foot", "m3", 100 * _FT**3, ""),
    ("g", "gram", "kg", 1e-3, "µmk"), ("oz", "ounce", "kg", _LB / 16, ""), ("lb", "pound", "kg", _LB, "k"), ("ton", "metric_ton", "kg", 1e3, ""), ("t", "short_ton", "kg", 2000 * _LB, ""),
    ("s", "second", "s", 1.0, "nµm"), ("cs", "hundredths_second", "s", 1e-2, ""), ("ds", "tenths_second", "s", 1e-1, ""), ("min", "minute", "s", 60.0, ""), ("h", "hour", "s", 3600.0, ""), ("day", "day", "s", 86400.0, ""), ("wk", "week", "s", 604800.0, ""), ("mo", "julian_month", "s", 2629800.0, ""), ("yr", "year", "s", 31557600.0, ""),
    ("J", "joule", _ENERGY, 1.0, "kMG"), ("Wh", "watt_hour", _ENERGY, 3600.0, "kM"), ("BTU", "btu", _ENERGY, _BTU, "kM"), ("hph", "horsepower_hour", _ENERGY, 745.6998715822702 * 3600, ""), ("cal", "calorie", _ENERGY, 4.184, ""), ("therm", "therm", _ENERGY, 1e5 * _BTU, ""), ("tonrefh", "tons_refrigeration_hour", _ENERGY, 12e3 * _BTU, ""), ("Nm", "newton_meter", _ENERGY, 1.0, ""), ("VAh", "volt_ampere_hour", _ENERGY, 3600.0, "kM"), ("VARh", "volt_ampere_reactive_hour", _ENERGY, 3600.0, "kM"),
    ("W", "watt", _POWER, 1.0, "mkMG"), ("hp", "horsepower", _POWER, 745.6998715822702, ""), ("tonref", "tons_refrigeration", _POWER, 12e3 * _BTU / 3600, ""), ("ftlbs/sec", "foot_pounds_per_second", _POWER, 1.3558179483314004, ""), ("VA", "volt_ampere", _POWER, 1.0, "kM"), ("mVA", "megavolt_ampere", _POWER, 1e6, ""), ("VAR", "volt_ampere_reactive", _POWER, 1.0, "kM"),
    ("Pa", "pascal", _PRESSURE, 1.0, "hk"), ("bar", "bar", _PRESSURE, 1e5, "m"), ("atm", "atmosphere", _PRESSURE, 101325.0, ""), ("psi", "pounds_per_square_inch", _PRESSURE, 6894.757293168, ""), ("inH₂O", "inches_of_water", _PRESSURE, 249.08891, ""), ("cmH₂O", "centimeters_of_water", _PRESSURE, 98.0665, ""), ("mmHg", "millimeters_of_mercury", _PRESSURE, 133.322387415, ""), ("cmHg", "centimeters_of_mercury", _PRESSURE, 1333.22387415, ""), ("inHg", "inches_of_mercury", _PRESSURE, 3386.388640341, ""),
    ("N", "newton", "kg m s-2", 1.0, "k"), ("lbf", "pound_force", "kg m s-2", 4.4482216152605, ""), ("Ns", "newton_second", "kg m s-1", 1.0, ""), ("Js", "joule_second", "kg m2 s-1", 1.0, ""),
    ("A", "ampere", "A", 1.0, "m"), ("C", "coulomb", "A s", 1.0, ""), ("Ah", "ampere_hour", "A s", 3600.0, ""), ("V", "volt", _VOLTAGE, 1.0, "mkM"), ("Ω", "ohm", _OHM, 1.0, "mkM"), ("Ωm", "ohm_meter", "A-2 kg m3 s-3", 1.0, ""), ("S", "siemens", "A2 kg-1 m-2 s3", 1.0, ""), ("F", "farad", "A2 kg-1 m-2 s4", 1.0, ""), ("H", "henry", "A-2 kg m2 s-2", 1.0, ""), ("Wb", "weber", "A-1 kg m2 s-2", 1.0, ""), ("T", "tesla", "A-1 kg s-2", 1.0, ""), ("Am²", "ampere_square_meter", "A m2", 1.0, ""),
    ("cd", "candela", "cd", 1.0, ""), ("lm", "lumen", "cd sr", 1.0, ""), ("lx", "lux", "cd m-2 sr", 1.0, ""), ("fc", "footcandle", "cd m-2 sr", 1 / _FT**2, ""), ("phot", "phot", "cd m-2 sr", 1e4, ""), ("sr", "steradian", "sr", 1.0, ""),
    ("Hz", "hertz", "s-1", 1.0, "kM"), ("cph", "cycles_per_hour", "s-1", 1 / 3600, ""), ("cpm", "cycles_per_minute", "s-1", 1 / 60, ""), ("ACH", "air_changes_per_hour", "s-1", 1 / 3600, ""), ("rad", "radian", "rad", 1.0, ""), ("deg", "degrees_angular", "rad", math.pi / 180, ""), ("degPh", "degrees_phase", "rad", math.pi / 180, ""), ("rpm", "revolutions_per_minute", "rad s-1", math.pi / 30, ""),
    ("mph", "miles_per_hour", "m s-1", 0.44704, ""), ("knot", "knot", "m s-1", 1852 / 3600, ""), ("cfs", "cubic_feet_per_second", "m3 s-1", _FT**3, ""), ("cfm", "cubic_feet_per_minute", "m3 s-1", _FT**3 / 60, "k"), ("cfh", "cubic_feet_per_hour", "m3 s-1", _FT**3 / 3600, ""), ("gpm", "gallons_per_minute", "m3 s-1", _GAL / 60, ""), ("gph", "gallons_per_hour", "m3 s-1", _GAL / 3600, ""),
    ("%", "percent", "", 0.01, ""), ("ppu", "parts_per_unit", "", 1.0, ""), ("ppm", "parts_per_million", "", 1e-6, ""), ("ppb", "parts_per_billion", "", 1e-9, ""), ("COP", "coefficient_of_performance", "", 1.0, ""), ("EER", "energy_efficiency_ratio", "", _BTU / 3600, ""), ("PUE", "power_usage_effectiveness", "", 1.0, ""), ("B", "byte", "byte", 1.0, "kMGTP"),
    ("kW/ton", "kilowatt_per_ton", "", 1e3 * 3600 / (12e3 * _BTU), ""), ("gH₂O/kgAir", "grams_of_water_per_kilogram_dry_air", "", 1e-3, ""), ("W/m²_irr", "watts_per_square_meter_irradiance", "kg s-3", 1.0, ""), ("W/ft²_irr", "watts_per_square_foot_irradiance", "kg s-3", 1 / _FT**2, ""), ("°daysC", "degree_days_celsius", "K s", 86400.0, ""), ("°daysF", "degree_days_fahrenheit", "K s", 48000.0, ""),
    ("ΔK", "kelvin_degrees", "K", 1.0, ""), ("Δ°C", "celsius_degrees", "K", 1.0, ""), ("Δ°F", "fahrenheit_degrees", "K", 5 / 9, ""),
)
#: Temperatures as such, with the shift to kelvin.
TEMPERATURES = (("K", "kelvin", 1.0, 0.0), ("°C", "celsius", 1.0, 273.15), ("°F", "fahrenheit", 5 / 9, 459.67 * 5 / 9))
#: Other spellings.
SPELLINGS = {"sec": "s", "hr": "h", "Volt": "V", "btu": "BTU", "Btu": "BTU", "MMBTU": "MBTU", "in/wc": "inH₂O", "kilohm": "kΩ", "megohm": "MΩ", "Ω": "Ω", "kΩ": "kΩ", "MΩ": "MΩ", "mΩ": "mΩ", "Ωm": "Ωm"}

_TIMES, _AREAS = ("s", "sec", "min", "h", "hr", "day"), ("m²", "ft²", "in²")
#: By dimension, what its units stand over. After a / a further one divides; flows are divided by as a whole.
OVER = {
    "m": (*_TIMES, "s²"), "m3": _TIMES, "rad": (*_TIMES, "s²"), "K": _TIMES, "cd": _AREAS, "A": (*_AREAS, "m"), "A2 kg-1 m-2 s3": ("m",), "kg m s-2": ("m",), _VOLTAGE: ("m", "K"), _PRESSURE: ("°F", "K"), "m2": ("N",),
    "kg": (*_TIMES, *_AREAS, "m³", "ft³", "L", "kg", "g", "lb", "kg_dry"),
    _ENERGY: (*_TIMES, *_AREAS, "g", "kg", "lb", "kg_dry", "lb_dry", "K", "°K", "kg°K", "Wh", "h/m²", "h/ft²"),
    _POWER: (*_AREAS, "m²K", "m°K", "m³/s", "cfm", "kcfm", "gal/min"),
}
#: Name, dimension and factor of what is only divided by.
UNDER = {
    "K": ("degree_kelvin", "K", 1.0), "°K": ("degree_kelvin", "K", 1.0), "°F": ("degree_fahrenheit", "K", 5 / 9), "kg_dry": ("kilogram_dry_air", "kg", 1.0), "lb_dry": ("pound_dry_air", "kg", _LB), "s²": ("second_squared", "s2", 1.0), "kg°K": ("kilogram_degree_kelvin", "K kg", 1.0),
    "m²K": ("square_meter_degree_kelvin", "K m2", 1.0), "m°K": ("meter_degree_kelvin", "K m", 1.0), "m³/s": ("cubic_meters_per_second", "m3 s-1", 1.0), "gal/min": ("gallons_per_minute", "m3 s-1", _GAL / 60), "h/m²": ("hour_per_square_meter", "m2 s", 3600.0), "h/ft²": ("hour_per_square_foot", "m2 s", 3600 * _FT**2),
}


def _divided(a: str, b: str) -> str:
    """The dimension of a / b."""
    held = Counter()
    for text, sign in ((a, 1), (b, -1)):
        for base, n in re.findall(r"([A-Za-z]+)(-?\d*)", text):
            held[base] += sign * int(n or 1)
    return " ".join(f"{base}{'' if n == 1 else n}" for base, n in sorted(held.items()) if n)


def _plural(name: str) -> str:
    head, _, last = name.rpartition("_")
    last = {"foot": "feet", "inch": "inches"}.get(last, last if last.endswith(("s", "z")) else f"{last}s")
    return f"{head}_{last}" if head else last


@lru_cache
def known_units() -> dict[str, tuple[str, float, float]]:
    """Symbol or name -> dimension, factor, shift: base = value * factor + shift."""
    plain: dict[str, tuple[str, str, float]] = {}
    for symbol, name, dimension, factor, prefixes in SIMPLE:
        plain[symbol] = (name, dimension, factor)
        for p in prefixes:
            plain[p + symbol] = (PREFIXES[p][0] + name, dimension, PREFIXES[p][1] * factor)
    for symbol, (name, dimension, factor) in list(plain.items()):
        if dimension == "m":
            plain[f"{symbol}²"], plain[f"{symbol}³"] = (f"square_{name}", "m2", factor**2), (f"cubic_{name}", "m3", factor**3)
    for other, symbol in SPELLINGS.items():
        plain[other] = plain[symbol]
    above = plain | {"°C": ("degree_celsius", "K", 1.0), "°F": ("degree_fahrenheit", "K", 5 / 9), "K": ("degree_kelvin", "K", 1.0)}
    out: dict[str, tuple[str, float, float]] = {}
    for symbol, (name, dimension, factor) in above.items():
        for below in OVER.get(dimension, ()):
            name_below, by, divisor = UNDER[below] if below in UNDER else plain[below]
            named = f"degrees_{name[7:]}" if name.startswith("degree_") else _plural(name)
            for key in (f"{symbol}/{below}", f"{named}_per_{name_below}"):
                out.setdefault(key, (_divided(dimension, by), factor / divisor, 0.0))
    for symbol, (name, dimension, factor) in plain.items():
        out[symbol] = out[name] = (dimension, factor, 0.0)
    for symbol, name, factor, shift in TEMPERATURES:
        out[symbol] = out[name] = ("temperature", factor, shift)
    return out


def unit_table(spark: SparkSession, more: tuple = ()) -> DataFrame:
    rows = [(symbol, *held) for symbol, held in known_units().items()]
    return spark.createDataFrame([*rows, *more], "symbol string, dimension string, factor double, shift double")


def converted(df: DataFrame, val: str, unit: str, target: str, out: str = "converted", units: DataFrame | None = None) -> DataFrame:
    """Adds val in the unit that column `target` names; null where the dimensions differ or a unit is unknown.

    A value whose unit is its target stays as it is, known or not. The table of units is fixed and small (some thousand
    rows), so both joins broadcast it.
    """
    units = unit_table(df.sparkSession) if units is None else units
    side = lambda k: F.broadcast(units.select(F.col("symbol").alias(f"_s{k}"), F.col("dimension").alias(f"_d{k}"), F.col("factor").alias(f"_f{k}"), F.col("shift").alias(f"_o{k}")))
    both = df.join(side(1), F.col(unit) == F.col("_s1"), "left").join(side(2), F.col(target) == F.col("_s2"), "left")
    value = F.when(F.col("_d1") == F.col("_d2"), (F.col(val) * F.col("_f1") + F.col("_o1") - F.col("_o2")) / F.col("_f2"))
    return both.withColumn(out, F.when(F.col(unit) == F.col(target), F.col(val)).otherwise(value)).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def factor_to(unit: Column, target: str) -> Column:
    """For one fixed target without shift: the factor as an expression of the unit's column."""
    dimension, own, _ = known_units()[target]
    pairs = [x for symbol, (d, factor, _) in known_units().items() if d == dimension for x in (F.lit(symbol), F.lit(factor / own))]
    return F.create_map(*pairs)[unit]
