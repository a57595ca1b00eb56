"""Synthetic service-shop data, generated by Spark at any size.

Fan-out per customer key (vehicles) and per vehicle (services) is an
``explode(sequence(..))``; every random choice is an integer mix of (seed,
id, field) that any engine can compute, so a row depends only on (seed, its
ids): the same seed gives the same rows for any partitioning, and nothing
goes through the driver except the 8 curated rows. Sizes: about 2 vehicles
and 5 services per customer, plus the 8 curated services, whose vehicles
1 to 8 belong to the customer of the smallest key.

Not copied: dates relative to today (a fixed ``as_of`` date is used) and
5-digit VINs that run out at 100k vehicles (the VIN carries the whole id).
"""
from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (AC_VENT_TEMPS, BATTERY_AGE_YEARS, BATTERY_VOLTS, COMPONENT_KEYS,
                         COMPONENTS_PER_SERVICE, FRONT_PAD_CHOICES, MODEL_TYPES, N_TECHNICIANS,
                         PHRASES, REAR_PAD_CHOICES, SERVICE_DAYS_BACK, SERVICE_TYPES,
                         SERVICES_PER_VEHICLE, SPECIALIZATIONS, TREAD_CHOICES, VEHICLE_MAKE,
                         VEHICLE_YEARS, VEHICLES_PER_CUSTOMER)
from ..functions.lookup import jvm_cached, pick, zero_padded
from ..functions.rules import BALANCED, ac_class, battery_class, brakes_class, tires_class
from .fixtures import demo_services

AS_OF = "2024-06-30"
N_DEMO = 8


#: The mix works modulo this prime; all products stay below 2^63.
PRIME, FACTOR = 2147483647, 48271


def salt(seed: int, field: str, i: int = 0) -> int:
    return zlib.crc32(f"{seed}/{field}/{i}".encode()) % PRIME


def _h(seed: int, of: Column, field: str, i: int = 0) -> Column:
    """A number below PRIME for (seed, id, field, i)."""
    c = salt(seed, field, i)
    x = (F.pmod(of, F.lit(PRIME).cast("long")) * FACTOR + c) % PRIME
    return (x * (x % 65536 + 1) + c) % PRIME


def _pick(choices: list, seed: int, of: Column, field: str, i: int = 0) -> Column:
    return pick(choices, _h(seed, of, field, i) % len(choices) + 1)


def _between(lo: int, hi: int, seed: int, of: Column, field: str) -> Column:
    return (F.lit(lo) + _h(seed, of, field) % (hi - lo + 1)).cast("int")


def customers(customer_keys: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer_keys.select(
        k.alias("customer_id"), F.lit("Customer").alias("first_name"),
        k.cast("string").alias("last_name"),
        F.concat(F.lit("customer."), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("555-"), zero_padded(k, 7)).alias("phone"),
        F.concat(F.lit("Street "), k.cast("string")).alias("address"))


def vehicles(customer_keys: DataFrame, seed: int = 42) -> DataFrame:
    c = F.col("c_custkey")
    lo, hi = VEHICLES_PER_CUSTOMER
    v = customer_keys.select(c.alias("customer_id"),
                             F.explode(F.sequence(F.lit(1), _between(lo, hi, seed, c, "nv")))
                             .alias("vi"))
    own = v.select((F.col("customer_id") * hi + F.col("vi") + N_DEMO).alias("vehicle_id"), "customer_id")
    demo = customer_keys.agg(F.min("c_custkey").alias("customer_id")).where("customer_id is not null").select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N_DEMO).cast("long"))).alias("vehicle_id"), "customer_id")
    vid = F.col("vehicle_id")
    return own.unionByName(demo).select(
        "vehicle_id", "customer_id", F.lit(VEHICLE_MAKE).alias("make"),
        _pick(MODEL_TYPES, seed, vid, "model").alias("model"),
        _between(*VEHICLE_YEARS, seed, vid, "year").alias("year"),
        F.concat(F.lit("1HGBH41JX"), zero_padded(vid, 8)).alias("vin"))


def technicians(spark: SparkSession, seed: int = 42) -> DataFrame:
    t = F.col("id")
    return spark.range(1, N_TECHNICIANS + 1).select(
        t.cast("int").alias("technician_id"), F.lit("Technician").alias("first_name"),
        t.cast("string").alias("last_name"),
        _pick(SPECIALIZATIONS, seed, t, "spec").alias("specialization"))


def _observation(key: str, sid: Column, seed: int) -> Column:
    """struct(key, text, severity) of one component for one service."""
    def txt(c):
        return c.cast("string")
    if key == "tires":
        tr = [_pick(TREAD_CHOICES, seed, sid, key, i) for i in range(4)]
        text = F.concat(F.lit("Tread depth (32nds): LF "), txt(tr[0]), F.lit(", RF "), txt(tr[1]),
                        F.lit(", LR "), txt(tr[2]), F.lit(", RR "), txt(tr[3]), F.lit("."))
        sev = tires_class(*tr, BALANCED)
    elif key == "brakes":
        i = _h(seed, sid, f"{key} front") % len(FRONT_PAD_CHOICES) + 1
        front = pick([float(x) for x in FRONT_PAD_CHOICES], i)
        front_txt = pick([str(x) for x in FRONT_PAD_CHOICES], i)
        rear = _pick(REAR_PAD_CHOICES, seed, sid, f"{key} rear")
        text = F.concat(F.lit("Brake pad thickness: front "), front_txt, F.lit("mm, rear "),
                        txt(rear), F.lit("mm."))
        sev = brakes_class(front, rear.cast("double"), BALANCED)
    elif key == "battery":
        lo, hi = (round(BATTERY_VOLTS[0] * 10), round(BATTERY_VOLTS[1] * 10))
        v10 = _between(lo, hi, seed, sid, f"{key} v")
        age = _between(*BATTERY_AGE_YEARS, seed, sid, f"{key} age")
        text = F.concat(F.lit("Battery: "), txt(F.floor(v10 / 10)), F.lit("."), txt(v10 % 10),
                        F.lit("V resting, age "), txt(age), F.lit(" yr."))
        sev = battery_class(v10.cast("double") / 10.0, age, BALANCED)
    elif key == "ac":
        t = _pick(AC_VENT_TEMPS, seed, sid, key)
        text = F.concat(F.lit("A/C: vent temp "), txt(t), F.lit("°F at max cool."))
        sev = ac_class(t, BALANCED)
    else:
        i = (_h(seed, sid, key) % 3 + 1).cast("int")
        text = pick(PHRASES[key], i)
        sev = pick(("Good", "Upcoming", "Urgent"), i)
    return F.struct(F.lit(key).alias("key"), text.alias("text"), sev.alias("sev"))


@jvm_cached
def _service_columns(seed: int, as_of: str) -> tuple[Column, Column, list[Column]]:
    """The columns of three projections: the components a service has, in their order; what is observed of each; the table's row."""
    sid = F.col("service_id")
    rank = {k: F.struct(_h(seed, sid, f"rank {k}").alias("h"), F.lit(k).alias("k")) for k in COMPONENT_KEYS}
    # 3 to 6 distinct components: the first ones by a hash of service and key (the key breaks ties).
    kept = F.transform(F.slice(F.sort_array(F.array(*rank.values())), 1, _between(*COMPONENTS_PER_SERVICE, seed, sid, "n")), lambda r: r["k"])
    # Only those are observed.
    made = F.array(*[F.when(F.array_contains("kept", k), F.struct(rank[k].alias("rank"), _observation(k, sid, seed).alias("o"))) for k in COMPONENT_KEYS])
    observed = F.transform(F.sort_array(F.filter(made, lambda r: r.isNotNull())), lambda r: r["o"])
    obs = F.col("obs")
    urgent = F.filter(obs, lambda o: o["sev"] == "Urgent")
    flag_i = (_h(seed, sid, "flag") % F.greatest(F.size(urgent), F.lit(1)) + 1).cast("int")
    return kept, observed, [
        sid, F.col("vehicle_id"),
        _between(1, N_TECHNICIANS, seed, sid, "tech").alias("technician_id"),
        F.date_sub(F.lit(as_of).cast("date"), _between(0, SERVICE_DAYS_BACK, seed, sid, "day"))
         .alias("service_date"),
        _pick(SERVICE_TYPES, seed, sid, "type").alias("service_type"),
        F.array_join(F.transform(obs, lambda o: o["text"]), " ").alias("service_performed"),
        F.when(F.size(urgent) > 0, F.array(F.element_at(urgent, flag_i)["key"]))
         .otherwise(F.array().cast("array<string>")).alias("flagged_components"),
        F.concat(F.lit("{"), F.array_join(F.transform(obs, lambda o: F.concat(
            F.lit('"'), o["key"], F.lit('": "'), o["sev"], F.lit('"'))), ", "), F.lit("}"))
         .alias("ground_truth")]


def services(spark: SparkSession, customer_keys: DataFrame, seed: int = 42,
             as_of: str = AS_OF, with_demo: bool = True) -> DataFrame:
    """The ``service`` table for the given customer keys (``c_custkey``).

    The keys are dealt out first: a file of keys is small, and what is made of
    one is not."""
    customer_keys = customer_keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    v = vehicles(customer_keys, seed).where(F.col("vehicle_id") > N_DEMO).select("vehicle_id")
    lo, hi = SERVICES_PER_VEHICLE
    vid = F.col("vehicle_id")
    s = v.select("vehicle_id", F.explode(F.sequence(F.lit(1), _between(lo, hi, seed, vid, "ns")))
                 .alias("si"))
    sid = F.col("vehicle_id") * hi + F.col("si") + N_DEMO
    s = s.select(sid.alias("service_id"), "vehicle_id")
    kept, observed, rows = _service_columns(seed, as_of)
    out = s.select("service_id", "vehicle_id", kept.alias("kept")).select("service_id", "vehicle_id", observed.alias("obs")).select(*rows)
    return demo_services(spark).unionByName(out) if with_demo else out


def generate(spark: SparkSession, customer_keys: DataFrame, seed: int = 42) -> dict[str, DataFrame]:
    """All four sample tables."""
    return {"customer": customers(customer_keys), "vehicle": vehicles(customer_keys, seed),
            "technician": technicians(spark, seed),
            "service": services(spark, customer_keys, seed)}
