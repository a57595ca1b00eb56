"""Service-shop tables derived from the supplied TPC-H-like parquet.

The supplied data has no service tables, so they are derived with plain
DataFrame expressions (see FIXTURES.md):

* ``service``    one row per distinct (l_orderkey, l_linenumber) of lineitem;
* ``vehicle``    one row per order;
* ``customer``   one row per customer;
* ``technician`` one row per supplier.

Everything is lazy; Catalyst prunes the scans to the columns used. The one
shuffle is the (l_orderkey, l_linenumber) aggregation, with map-side partial
aggregation, so a hot key is collapsed before it is shuffled.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..constants import (SEED_COMPONENTS, AC_VENT_TEMPS, DEMO_DATE, DEMO_SERVICE_TYPE, DEMO_SERVICES,
                         MODEL_TYPES, PHRASES, SERVICE_TYPES, SPECIALIZATIONS, VEHICLE_MAKE)
from ..functions.rules import (BALANCED, ac_class, battery_class, brakes_class,
                               tires_class)
from ..functions.lookup import jvm_cached, pick, zero_padded
from ..session import small_methods
from .tables import read_table

_LEVELS = ("Good", "Upcoming", "Urgent")

# Presence rule and class selector of each phrase component, over the
# per-line numbers ln (line number), q (quantity), d (discount %), t (tax %)
# and rf (return flag). ln = 6 carries no piece, which gives empty notes.
_CLASS_BY_RF = {"A": 0, "N": 1, "R": 2}


def _pieces(ln: Column, q: Column, d: Column, t: Column, pk: Column, sk: Column,
            rf: Column) -> list[tuple[str, Column, Column]]:
    """(component, piece text or NULL, balanced severity or NULL) in notes order."""
    def s(c: Column) -> Column:
        return c.cast("string")

    lf, rfr, lr, rr = (F.lit(2) + q % 8, F.lit(2) + (q + 3) % 8,
                       F.lit(2) + (q + d) % 8, F.lit(2) + (q + t) % 8)
    front = F.when(d == 0, F.lit(1.5)).otherwise((F.lit(1) + d).cast("double"))
    front_txt = F.when(d == 0, F.lit("1.5")).otherwise(s(F.lit(1) + d))
    rear = F.lit(2) + t
    v = F.lit(114) + pk % 15
    volts = (v.cast("double") / 10.0)
    volts_txt = F.concat(F.when(v < 120, F.lit("11.")).otherwise(F.lit("12.")), s(v % 10))
    age = F.lit(1) + sk % 7
    temp = pick(AC_VENT_TEMPS, q % 6 + 1)

    measured = {
        "tires": (ln % 3 != 0,
                  F.concat(F.lit("Tread depth (32nds): LF "), s(lf), F.lit(", RF "), s(rfr),
                           F.lit(", LR "), s(lr), F.lit(", RR "), s(rr), F.lit(".")),
                  tires_class(lf, rfr, lr, rr, BALANCED)),
        "brakes": (ln % 2 == 1,
                   F.concat(F.lit("Brake pad thickness: front "), front_txt,
                            F.lit("mm, rear "), s(rear), F.lit("mm.")),
                   brakes_class(front, rear.cast("double"), BALANCED)),
        "battery": (ln % 4 < 2,
                    F.concat(F.lit("Battery: "), volts_txt, F.lit("V resting, age "), s(age),
                             F.lit(" yr.")),
                    battery_class(volts, age, BALANCED)),
        "ac": (ln % 5 == 0,
               F.concat(F.lit("A/C: vent temp "), s(temp), F.lit("°F at max cool.")),
               ac_class(temp, BALANCED)),
    }
    rf_idx = F.coalesce(*[F.when(rf == k, F.lit(i)) for k, i in _CLASS_BY_RF.items()],
                        F.lit(1))
    phrase_rules = {
        "suspension": (ln % 4 == 3, q % 3),
        "engine_oil": (ln % 3 == 1, d % 3),
        "coolant": (ln % 3 == 2, t % 3),
        "transmission_fluid": (ln % 4 == 1, (q + d) % 3),
        "belts_hoses": (ln % 5 == 2, (q + t) % 3),
        "lights_electrical": (ln == 4, rf_idx),
        "wipers": (ln == 2, rf_idx),
        "exhaust": (ln == 3, (d + t) % 3),
    }
    order = ["tires", "brakes", "battery", "suspension", "engine_oil", "coolant",
             "transmission_fluid", "belts_hoses", "lights_electrical", "wipers", "exhaust", "ac"]
    out = []
    for key in order:
        if key in measured:
            present, text, sev = measured[key]
        else:
            present, idx = phrase_rules[key]
            idx1 = (idx + 1).cast("int")
            text = pick(PHRASES[key], idx1)
            sev = pick(_LEVELS, idx1)
        out.append((key, F.when(present, text), F.when(present, sev)))
    return out


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct (l_orderkey, l_linenumber)."""
    small_methods(spark)
    li = read_table(spark, sf_dir, "lineitem")
    # min(l_returnflag) is taken over the flag's code point: equal to the
    # string minimum for a one-character flag (a longer one is an error),
    # and a fixed-width buffer keeps the aggregation a HashAggregate (a
    # string min forces a sort-based aggregate, i.e. an extra full sort of
    # lineitem before the shuffle).
    flag = F.when(F.length("l_returnflag") > 1, F.raise_error(F.lit("l_returnflag has more than one character"))
                  .cast("int")).otherwise(F.ascii("l_returnflag"))
    return (li.groupBy("l_orderkey", "l_linenumber")
         .agg(F.min("l_quantity").alias("mq"), F.min("l_discount").alias("md"),
              F.min("l_tax").alias("mt"), F.min("l_partkey").alias("pk"),
              F.min("l_suppkey").alias("sk"), F.min(flag).alias("rf_code"),
              F.min("l_shipdate").alias("ship"))
         .withColumn("rf", F.when(F.col("rf_code") == 0, F.lit(""))
                     .otherwise(F.chr(F.col("rf_code")))))


def service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``service`` table, one row per distinct (l_orderkey, l_linenumber)."""
    return _lines(spark, sf_dir).select(*_service_columns())


#: Keys of the two answer tables: they share tires only.
RESPONSE_KEYS = (("tires", "brakes"), ("tires", "wipers"))
RESPONSE_CASES = 13


def responses(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    """Answers of a model to every service (``raw``), with its defects: case
    ``(service_id + 5 * run) % 13`` is 0 no answer, 1 prose, 2 cut off, 3 an
    empty list, 4 in a code fence, 5 without the second key, 6 with a key not
    asked for, 7 with an unknown class, 8 with the first key twice, 9 without
    a reasoning, 10 without a name and class; the others are as they should."""
    g = _lines(spark, sf_dir)
    sid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    q, d = F.col("mq").cast("int"), F.round(F.col("md") * 100).cast("int")
    case = (sid + 5 * run) % RESPONSE_CASES
    first, second = RESPONSE_KEYS[run]

    def entry(component, classification, reasoning) -> Column:
        return F.to_json(F.struct(component.alias("component"), classification.alias("classification"),
                                  reasoning.alias("reasoning")))

    t, b = pick(_LEVELS, (q + run) % 3 + 1), pick(_LEVELS, (d + run) % 3 + 1)
    none = F.lit(None).cast("string")
    one = entry(F.when(case == 10, F.lit("")).otherwise(F.lit(first)),
                F.when(case == 7, F.lit("URGENT!")).when(case == 10, none).otherwise(t),
                F.when(case == 9, none).when(case == 10, F.lit("x"))
                .otherwise(F.concat(F.lit("tread "), q.cast("string"))))
    two = entry(F.lit(second), b, F.concat(F.lit("seen "), d.cast("string")))
    more = F.when(case == 6, entry(F.lit("horn"), F.lit("Good"), F.lit("loud"))) \
        .when(case == 8, entry(F.lit(first), F.lit("Good"), F.lit("second look")))
    body = F.concat(F.lit('{"assessments":['), F.concat_ws(",", one, F.when(case != 5, two), more), F.lit("]}"))
    raw = (F.when(case == 0, none)
           .when(case == 1, F.lit("The tires look worn."))
           .when(case == 2, F.concat(F.lit('{"assessments":['), one, F.lit(',{"component":"bra')))
           .when(case == 3, F.lit('{"assessments":[]}'))
           .when(case == 4, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .otherwise(body))
    return g.select(sid.alias("service_id"), F.col("l_orderkey").alias("vehicle_id"),
                    F.array().cast("array<string>").alias("flagged_components"), raw.alias("raw"))


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved configs, one per part: one to three seed components each, with
    bad and NULL component lists, empty descriptions and rubrics, and names
    that are NULL, without a letter, or alike but for signs."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    seeds = F.array(*[F.struct(F.lit(key).alias("component_key"), F.lit(name).alias("display_name"),
                               F.lit(desc).alias("description"), F.lit(rubric).alias("rubric"))
                      for key, name, desc, rubric, _ in SEED_COMPONENTS])

    def chosen(i: Column) -> Column:
        c = F.get(seeds, ((k + i) % len(SEED_COMPONENTS)).cast("int"))
        return F.struct(c["component_key"].alias("component_key"), c["display_name"].alias("display_name"),
                        F.when(k % 5 == 0, F.lit("")).otherwise(c["description"]).alias("description"),
                        F.when(k % 4 == 0, F.lit("")).otherwise(c["rubric"]).alias("rubric"))

    comps = F.to_json(F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), chosen))
    name = (F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 11 == 1, F.lit("!!!"))
            .when(k % 11 == 2, F.lit("My Config")).when(k % 11 == 3, F.lit("my-config"))
            .otherwise(F.col("p_name")))
    return p.select(
        F.concat(F.lit("0000000000cfg"), k.cast("string")).alias("config_id"), name.alias("name"),
        F.when(k % 7 == 0, F.lit("{not json")).when(k % 7 == 1, F.lit(None).cast("string"))
         .when(k % 7 == 2, F.lit("[]")).otherwise(comps).alias("components"),
        F.concat(F.lit("Assess part "), k.cast("string"), F.lit(".")).alias("prompt_text"))


@jvm_cached
def _service_columns() -> list[Column]:
    ln = F.col("l_linenumber")
    q = F.col("mq").cast("int")
    d = F.round(F.col("md") * 100).cast("int")
    t = F.round(F.col("mt") * 100).cast("int")
    pieces = _pieces(ln, q, d, t, F.col("pk"), F.col("sk"), F.col("rf"))
    flag1 = (F.when(ln % 6 == 0, F.lit(None).cast("string"))
             .when((ln % 6 == 1) & (q % 5 == 0), F.lit("tires"))
             .when((ln % 6 == 2) & (F.col("rf") == "R"), F.lit("wipers"))
             .otherwise(F.lit("")))
    truth = F.concat(F.lit("{"), F.concat_ws(", ", *[
        F.concat(F.lit(f'"{k}": "'), sev, F.lit('"')) for k, _, sev in pieces]), F.lit("}"))
    return [
        (F.col("l_orderkey") * 10 + ln).alias("service_id"),
        F.col("l_orderkey").alias("vehicle_id"),
        F.col("sk").cast("int").alias("technician_id"),
        F.col("ship").cast("date").alias("service_date"),
        pick(SERVICE_TYPES, q % 6 + 1).alias("service_type"),
        F.concat_ws(" ", *[text for _, text, _ in pieces]).alias("service_performed"),
        F.when(flag1.isNull(), F.lit(None).cast("array<string>"))
         .when(flag1 == "", F.array().cast("array<string>"))
         .otherwise(F.array(flag1)).alias("flagged_components"),
        truth.alias("ground_truth"),
    ]


def vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vehicle_from_orders(read_table(spark, sf_dir, "orders"))


def vehicle_from_orders(o: DataFrame) -> DataFrame:
    """One vehicle per order row of ``o`` (any filtered slice of orders)."""
    k = F.col("o_orderkey")
    return o.select(
        k.alias("vehicle_id"),
        F.col("o_custkey").alias("customer_id"),
        F.lit(VEHICLE_MAKE).alias("make"),
        pick(MODEL_TYPES, k % 6 + 1).alias("model"),
        (F.lit(2018) + k % 7).cast("int").alias("year"),
        F.concat(F.lit("1HGBH41JX"), zero_padded(k, 8)).alias("vin"),
    )


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.lit("Customer").alias("first_name"),
        F.regexp_extract("c_name", r"[0-9]+", 0).alias("last_name"),
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))),
                 F.lit("@example.com")).alias("email"),
        F.concat(F.lit("555-"), zero_padded(F.col("c_custkey"), 7)).alias("phone"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("address"),
    )


def technician(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.cast("int").alias("technician_id"),
        F.lit("Supplier").alias("first_name"),
        F.regexp_extract("s_name", r"[0-9]+", 0).alias("last_name"),
        pick(SPECIALIZATIONS, k % 5 + 1)
         .alias("specialization"),
    )


DERIVED = {"service": service, "vehicle": vehicle, "customer": customer,
           "technician": technician}


def demo_services(spark: SparkSession) -> DataFrame:
    """The 8 curated services (ids 1..8), used by the golden tests."""
    import datetime as dt
    day = dt.date.fromisoformat(DEMO_DATE)
    rows = [(i + 1, i + 1, i % 10 + 1, day, DEMO_SERVICE_TYPE, notes, flagged, json.dumps(gt))
            for i, (notes, flagged, gt) in enumerate(DEMO_SERVICES)]
    return spark.createDataFrame(rows, schemas.SERVICE)
