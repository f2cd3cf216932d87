"""Scalar expressions shared by all operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def clean(x: Column) -> Column:
    """NaN and infinities as null."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def number(text: Column) -> Column:
    """A text as a number, null where it is none."""
    return text.try_cast("double")


def positive_number(text: Column) -> Column:
    """A text as a number over 0, else null: suppressed ('M'), empty, zero and negative cells."""
    return F.when(number(text) > 0, number(text))


def month_end(when: Column) -> Column:
    """The last day of the month, whatever the time of day."""
    return F.last_day(F.to_date(when))


def period_month(period: Column) -> Column:
    """The month of a slot like M07; null for others."""
    return F.when(period.rlike(r"^M(0[1-9]|1[0-2])$"), F.substring(period, 2, 2).cast("int"))


def column_name(name: Column) -> Column:
    """A label as a column name: lower case, blanks to _, & to and, other signs dropped."""
    return F.regexp_replace(F.replace(F.replace(F.lower(name), F.lit("&"), F.lit("and")), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")


def growth_band(rate: Column) -> Column:
    """Five labels of growth, each interval closed on its right."""
    return (
        F.when(rate <= -0.1, "Strong Decline").when(rate <= -0.05, "Decline").when(rate <= 0.05, "Stable").when(rate <= 0.1, "Growth").when(rate > 0.1, "Strong Growth")
    )


def feature_kind(name: Column) -> Column:
    """The kind of a stored feature, told from its name."""
    return (
        F.when(name.startswith("lag_"), "lag")
        .when(name.startswith("ma_"), "moving_avg")
        .when(name.isin("yoy_change", "mom_change"), "pct_change")
        .when(name == "seasonal_component", "seasonal")
        .when(name == "trend", "trend")
        .otherwise("other")
    )


def calendar(ds: Column) -> dict[str, Column]:
    """Calendar columns of a date."""
    month, day = F.month(ds), F.day(ds)
    flag = lambda c: c.cast("int")
    return {
        "year": F.year(ds),
        "month": month,
        "quarter": F.quarter(ds),
        "day_of_month": day,
        "day_of_year": F.dayofyear(ds),
        "week_of_year": F.weekofyear(ds),
        "day_of_week": F.weekday(ds),
        "days_in_month": F.day(F.last_day(ds)),
        "is_weekend": flag(F.weekday(ds) >= 5),
        "is_holiday_season": flag(month.isin(11, 12)),
        "is_black_friday_month": flag(month == 11),
        "is_december": flag(month == 12),
        "is_january": flag(month == 1),
        "is_back_to_school": flag(month.isin(7, 8)),
        "is_summer": flag(month.isin(6, 7, 8)),
        "is_spring": flag(month.isin(3, 4, 5)),
        "is_fall": flag(month.isin(9, 10, 11)),
        "is_winter": flag(month.isin(12, 1, 2)),
        "is_quarter_end": flag(month.isin(3, 6, 9, 12)),
        "is_year_end": flag(month == 12),
        "is_payday": flag(day.between(14, 16) | (day >= 28)),
    }


def fourier(ds: Column) -> dict[str, Column]:
    """Cyclic and Fourier terms of a date, and progress through year, month and quarter."""
    turn = 2 * math.pi
    out = {}
    for name, x in {"month": F.month(ds) / 12, "quarter": F.quarter(ds) / 4}.items():
        out |= {f"{name}_sin": F.sin(turn * x), f"{name}_cos": F.cos(turn * x)}
    for k in (1, 2, 3):
        x = turn * k * F.dayofyear(ds) / 365.25
        out |= {f"year_sin_{k}": F.sin(x), f"year_cos_{k}": F.cos(x)}
    for k in (1, 2):
        x = turn * k * F.quarter(ds) / 4
        out |= {f"quarter_sin_{k}": F.sin(x), f"quarter_cos_{k}": F.cos(x)}
    return out | {
        "year_progress": F.dayofyear(ds) / 365.25,
        "month_progress": F.day(ds) / F.day(F.last_day(ds)),
        "quarter_progress": ((F.month(ds) - 1) % 3 + 1) / 3,
    }


# Keywords of a category's name and the flag they set; the first that fits counts.
CATEGORY_WORDS = {
    "electronics": ["electronic", "computer", "tech", "appliance"],
    "clothing": ["clothing", "apparel", "cloth", "fashion"],
    "home": ["home", "garden", "furniture", "building"],
    "auto": ["auto", "car", "motor", "gas"],
    "food": ["food", "beverage", "grocery", "restaurant"],
}
# Months in which a flag is set for a family of categories.
CATEGORY_SEASONS = {
    "electronics": {"tech_launch_season": [9, 10, 11], "is_super_bowl_month": [2]},
    "clothing": {"fashion_season": [2, 3, 4, 5], "is_swim_season": [5, 6, 7, 8], "is_coat_season": [1, 2, 10, 11, 12]},
    "home": {"spring_home_improvement": [3, 4, 5], "summer_garden_season": [5, 6, 7, 8], "fall_home_prep": [9, 10, 11]},
    "auto": {"summer_driving_season": [6, 7, 8], "is_tax_return_season": [3, 4]},
    "food": {"holiday_dining": [11, 12], "summer_bbq_season": [5, 6, 7, 8, 9]},
}


def category_kind(name: Column) -> Column:
    """Which family of categories a name belongs to."""
    out = None
    for kind, words in CATEGORY_WORDS.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | F.lower(name).contains(word)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def category_seasons(name: Column, ds: Column) -> dict[str, Column]:
    """Flags that are 1 in the months that matter to the family of a category."""
    kind, month = category_kind(name), F.month(ds)
    return {flag: ((kind == family) & month.isin(months)).cast("int") for family, flags in CATEGORY_SEASONS.items() for flag, months in flags.items()}


def holidays(ds: Column) -> dict[str, Column]:
    """Holidays of a date by rule: fixed days, n-th weekdays, and Easter Sunday."""
    y, m, day, weekday = F.year(ds), F.month(ds), F.day(ds), F.weekday(ds)
    nth = lambda month, wd, n: (m == month) & (weekday == wd) & (F.ceil(day / 7) == n)
    # Easter by the anonymous Gregorian rule
    a, b, c = y % 19, F.floor(y / 100), y % 100
    h = (19 * a + b - F.floor(b / 4) - F.floor((b - F.floor((b + 8) / 25) + 1) / 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * F.floor(c / 4) - h - c % 4) % 7
    n = h + k - 7 * F.floor((a + 11 * h + 22 * k) / 451) + 114
    easter = F.make_date(y, F.floor(n / 31).cast("int"), (n % 31 + 1).cast("int"))
    flags = {
        "new_year": (m == 1) & (day == 1),
        "memorial_day": (m == 5) & (weekday == 0) & (day > 24),
        "independence_day": (m == 7) & (day == 4),
        "labor_day": nth(9, 0, 1),
        "thanksgiving": nth(11, 3, 4),
        "black_friday": (m == 11) & (weekday == 4) & day.between(23, 29),
        "christmas": (m == 12) & (day == 25),
        "easter": F.to_date(ds) == easter,
    }
    return {f"is_{name}": flag.cast("int") for name, flag in flags.items()}
