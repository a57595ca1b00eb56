"""Rule-based severity: notes text -> readings -> class, as Spark Columns.

This is the offline scorer. Every expression here is a built-in Spark
function, so it runs inside whole-stage codegen with no Python in the loop.
Thresholds are per configuration (``balanced`` equals the data generator,
``strict`` is a tighter set used to give ``compare`` something real to do).
"""
from __future__ import annotations

import os

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NO_SIGNAL_REASONING, PHRASES
from .lookup import jvm_cached, pick

# Patterns of the measured components. Written so Java regex and RE2 agree.
TIRES_RE = r"Tread depth \(32nds\): LF (\d+), RF (\d+), LR (\d+), RR (\d+)\."
BRAKES_RE = r"Brake pad thickness: front ([0-9]+(?:\.[0-9]+)?)mm, rear ([0-9]+(?:\.[0-9]+)?)mm\."
BATTERY_RE = r"Battery: ([0-9]+(?:\.[0-9]+)?)V resting, age (\d+) yr\."
AC_RE = r"A/C: vent temp (\d+)°F at max cool\."

MEASURED = ("tires", "brakes", "battery", "ac")


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs of the measured components for one configuration."""
    name: str = "balanced"
    tires_urgent_below: float = 3.0
    tires_upcoming_max: float = 4.0
    brakes_urgent_below: float = 2.5
    brakes_upcoming_max: float = 4.0
    battery_urgent_volts_below: float = 11.8
    battery_urgent_age_min: int = 6
    battery_upcoming_volts_below: float = 12.3
    battery_upcoming_age_min: int = 4
    ac_good_max: int = 48
    ac_upcoming_max: int = 60


BALANCED = Thresholds()
STRICT = Thresholds(
    name="strict",
    tires_urgent_below=4.0, tires_upcoming_max=5.0,
    brakes_urgent_below=2.0, brakes_upcoming_max=4.0,
    battery_urgent_volts_below=12.0, battery_urgent_age_min=6,
    battery_upcoming_volts_below=12.4, battery_upcoming_age_min=3,
    ac_good_max=44, ac_upcoming_max=55,
)


def _num(s: Column, typ: str) -> Column:
    # No sentence, no reading; a number beyond the type is no reading either.
    return F.nullif(s, F.lit("")).try_cast(typ)


# The scorer runs in three projections, so that each regex scans the notes
# once per row. Subexpression elimination does not reach into CASE
# branches, and a reading used by a threshold band would otherwise be
# re-extracted for every use. CollapseProject keeps the layers apart
# because it never duplicates a non-cheap expression such as a regex.
#   1. signals:  per component, the matched reading sentence (measured) or
#                the matched phrase's level 0/1/2 (phrase components);
#   2. readings: the numbers of each short sentence, found by one
#                ``regexp_extract_all`` scan (one scan per sentence instead of
#                one full match per number), then picked out by position;
#   3. classes:  threshold bands over plain columns, one set per config.
SIGNAL_PREFIX = "_sig_"
NUMBERS_PREFIX = "_num_"
READING_PREFIX = "_val_"
# A number in a reading sentence. Every number of a matched sentence is a
# capture group of its pattern except the "32" of "(32nds)", which is why
# the tire numbers start at position 1.
NUMBER_RE = r"[0-9]+(?:\.[0-9]+)?"
_FIRST_NUMBER = {"tires": 1, "brakes": 0, "battery": 0, "ac": 0}
_PATTERNS = {"tires": TIRES_RE, "brakes": BRAKES_RE, "battery": BATTERY_RE, "ac": AC_RE}
_LEVELS = ("Good", "Upcoming", "Urgent")


def _sig(key: str) -> str:
    return SIGNAL_PREFIX + key


def _val(name: str) -> str:
    return READING_PREFIX + name


def _nums(key: str) -> str:
    return NUMBERS_PREFIX + key


def _numbers(key: str) -> Column:
    """All numbers of the matched sentence of a measured component, as text."""
    return F.regexp_extract_all(F.col(_sig(key)), F.lit(NUMBER_RE), 0)


def _signal(key: str, notes: Column) -> Column:
    if key in MEASURED:
        return F.regexp_extract(notes, _PATTERNS[key], 0)
    good, upcoming, urgent = PHRASES[key]
    # Most severe phrase first when a note holds several. What the three
    # phrases begin with is looked for once; most notes end there.
    level = (F.when(notes.contains(urgent), F.lit(2))
             .when(notes.contains(upcoming), F.lit(1))
             .when(notes.contains(good), F.lit(0)))
    lead = os.path.commonprefix([good, upcoming, urgent])
    return F.when(notes.contains(lead), level) if lead else level


def _group(key: str, i: int, typ: str) -> Column:
    """Capture group ``i`` (1-based) of a measured pattern, from the numbers
    column; NULL when the sentence is absent."""
    return _num(F.get(F.col(_nums(key)), _FIRST_NUMBER[key] + i - 1), typ)


def _readings_of(key: str) -> dict[str, Column]:
    if key == "tires":
        return {"tires": F.least(*[_group("tires", i, "int") for i in range(1, 5)])}
    if key == "brakes":
        return {"brakes": F.least(*[_group("brakes", i, "double") for i in (1, 2)])}
    if key == "battery":
        return {"battery_volts": _group("battery", 1, "double"),
                "battery_age": _group("battery", 2, "int")}
    return {"ac": _group("ac", 1, "int")}


@jvm_cached
def _layers(keys: tuple[str, ...], notes_col: str) -> tuple[dict, dict, dict]:
    notes = F.col(notes_col)
    wanted = [k for k in dict.fromkeys(keys) if k in MEASURED or k in PHRASES]
    sig = {_sig(k): _signal(k, notes) for k in wanted}
    nums = {_nums(k): _numbers(k) for k in wanted if k in MEASURED}
    vals = {_val(n): c for k in wanted if k in MEASURED for n, c in _readings_of(k).items()}
    return sig, nums, vals


def with_signals(df: DataFrame, keys: list[str], notes_col: str) -> tuple[DataFrame, list[str]]:
    """Add the hidden signal and reading columns the rule classes of
    ``keys`` need; returns the frame and the names it added (columns
    already present are kept, so two configs share one extraction)."""
    have = set(df.columns)
    sig, nums, vals = _layers(tuple(keys), notes_col)
    sig = {k: c for k, c in sig.items() if k not in have}
    vals = {k: c for k, c in vals.items() if k not in have}
    nums = {k: c for k, c in nums.items() if k not in have} if vals else {}
    if sig:
        df = df.withColumns(sig)
    if nums:
        df = df.withColumns(nums)
    if vals:
        df = df.withColumns(vals).drop(*nums)
    return df, [*sig, *vals]


def readings(df: DataFrame, notes_col: str = "service_performed") -> DataFrame:
    """All numeric readings of a notes column (NULL when not present), added
    as columns; each sentence is found by one regex scan of the notes."""
    notes = F.col(notes_col)
    sent = {_sig(k): F.regexp_extract(notes, _PATTERNS[k], 0) for k in MEASURED}
    nums = {_nums(k): _numbers(k) for k in MEASURED}
    df = df.withColumns(sent).withColumns(nums)
    grp = _group

    out = {
        "tread_lf": grp("tires", 1, "int"), "tread_rf": grp("tires", 2, "int"),
        "tread_lr": grp("tires", 3, "int"), "tread_rr": grp("tires", 4, "int"),
        "pad_front_mm": grp("brakes", 1, "double"), "pad_rear_mm": grp("brakes", 2, "double"),
        "battery_volts": grp("battery", 1, "double"), "battery_age_yr": grp("battery", 2, "int"),
        "ac_vent_f": grp("ac", 1, "int"),
    }
    return df.withColumns(out).drop(*sent, *nums)


def _band(value: Column, urgent: Column, upcoming: Column) -> Column:
    return (F.when(value.isNull(), F.lit(None).cast("string"))
            .when(urgent, F.lit("Urgent"))
            .when(upcoming, F.lit("Upcoming"))
            .otherwise(F.lit("Good")))


def tires_class(lf: Column, rf: Column, lr: Column, rr: Column, th: Thresholds) -> Column:
    mn = F.least(lf, rf, lr, rr)
    return _band(mn, mn < F.lit(th.tires_urgent_below), mn <= F.lit(th.tires_upcoming_max))


def brakes_class(front: Column, rear: Column, th: Thresholds) -> Column:
    mn = F.least(front, rear)
    return _band(mn, mn < F.lit(th.brakes_urgent_below), mn <= F.lit(th.brakes_upcoming_max))


def battery_class(volts: Column, age: Column, th: Thresholds) -> Column:
    return _band(
        volts,
        (volts < F.lit(th.battery_urgent_volts_below)) | (age >= F.lit(th.battery_urgent_age_min)),
        (volts < F.lit(th.battery_upcoming_volts_below)) | (age >= F.lit(th.battery_upcoming_age_min)),
    )


def ac_class(temp: Column, th: Thresholds) -> Column:
    return (F.when(temp.isNull(), F.lit(None).cast("string"))
            .when(temp <= F.lit(th.ac_good_max), F.lit("Good"))
            .when(temp <= F.lit(th.ac_upcoming_max), F.lit("Upcoming"))
            .otherwise(F.lit("Urgent")))


def _measured(key: str, th: Thresholds) -> tuple[Column, Column]:
    """(class, reasoning) of a measured component from its reading
    columns; NULLs when absent."""
    why = F.nullif(F.col(_sig(key)), F.lit(""))
    v = F.col
    if key == "tires":
        mn = v(_val("tires"))
        cls = _band(mn, mn < F.lit(th.tires_urgent_below), mn <= F.lit(th.tires_upcoming_max))
    elif key == "brakes":
        mn = v(_val("brakes"))
        cls = _band(mn, mn < F.lit(th.brakes_urgent_below), mn <= F.lit(th.brakes_upcoming_max))
    elif key == "battery":
        cls = battery_class(v(_val("battery_volts")), v(_val("battery_age")), th)
    else:
        cls = ac_class(v(_val("ac")), th)
    return cls, why


def _phrase(key: str) -> tuple[Column, Column]:
    level = F.col(_sig(key))
    cls = pick(_LEVELS, level + 1)
    why = pick(PHRASES[key], level + 1)
    return cls, why


def component_rule(key: str, th: Thresholds = BALANCED) -> tuple[Column, Column]:
    """(classification, reasoning) for one component over the columns of
    :func:`with_signals`; no signal -> Good."""
    if key in MEASURED:
        cls, why = _measured(key, th)
    elif key in PHRASES:
        cls, why = _phrase(key)
    else:
        return F.lit("Good"), F.lit(NO_SIGNAL_REASONING)
    return (F.coalesce(cls, F.lit("Good")),
            F.when(cls.isNull(), F.lit(NO_SIGNAL_REASONING)).otherwise(why))


def assessment(key: str, th: Thresholds = BALANCED) -> Column:
    """One assessment struct (component, classification, reasoning)."""
    cls, why = component_rule(key, th)
    return F.struct(F.lit(key).alias("component"), cls.alias("classification"),
                    why.alias("reasoning"))


def assessments(keys: list[str], th: Thresholds = BALANCED) -> Column:
    """Array of assessments, one per requested key in the given order, over
    the columns of :func:`with_signals`. Built per row: scoring a table
    never shuffles."""
    return _assessments(tuple(keys), th)


@jvm_cached
def _assessments(keys: tuple[str, ...], th: Thresholds) -> Column:
    return F.array(*[assessment(k, th) for k in keys])
