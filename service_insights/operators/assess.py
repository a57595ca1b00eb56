"""From a scored frame to one row per (service, component), and the checks
around that step. All row-local work uses built-in and higher-order
functions; the only shuffles are those of keyed operators (dedupe, counts),
which reduce the rows map-side before they shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLASSES
from ..functions import json_text
from ..functions.arrays import explode_rows  # noqa: F401 (re-exported)

CATCH_CLASSES = ["Urgent", "Upcoming"]


def flagged_array(col: str = "flagged_components") -> Column:
    """NULL list -> empty list."""
    return F.coalesce(F.col(col), F.array().cast("array<string>"))


def technician_flagged(flagged: Column, component: Column) -> Column:
    """Membership; a NULL answer (NULL needle or NULL element) counts as not flagged."""
    return F.coalesce(F.array_contains(flagged, component), F.lit(False))


def explode_assessments(scored: DataFrame, keep: list[str] | None = None,
                        with_pos: bool = False, components: list[str] | None = None,
                        where=None) -> DataFrame:
    """One row per returned assessment. Unparsed answers, NULL and empty
    lists give no rows (``parse_status`` counts them)."""
    keep = keep if keep is not None else ["service_id", "service_performed"]
    flagged = flagged_array()
    answer = F.col("result.assessments")
    if components is not None or where is not None:
        # Restricting inside the answer, before the explode, keeps positions
        # and drops the unwanted rows before they exist. ``where`` maps an
        # assessment struct to a boolean Column (NULL drops the entry).
        def wanted(a):
            ok = F.lit(True)
            if components is not None:
                ok = ok & a["component"].isin(*components)
            if where is not None:
                ok = ok & where(a)
            return F.coalesce(ok, F.lit(False))
        answer = F.filter(F.transform(answer, lambda a, i: F.struct(i.alias("i"), a.alias("a"))),
                          lambda e: wanted(e["a"]))
        rows = explode_rows(scored, [*keep, flagged.alias("_flagged")], answer, val="e")
        rows = rows.select(*keep, "_flagged", F.col("e.i").alias("pos"), F.col("e.a").alias("a"))
    else:
        rows = explode_rows(scored, [*keep, flagged.alias("_flagged")], answer, val="a", pos="pos")
    cols = [F.col(k) for k in keep] + [
        F.col("a.component").alias("component_key"),
        F.col("a.classification").alias("classification"),
        F.col("a.reasoning").alias("reasoning"),
        technician_flagged(F.col("_flagged"), F.col("a.component")).alias("technician_flagged"),
    ]
    if with_pos:
        cols.append(F.col("pos"))
    return rows.select(*cols)


def is_catch(flagged: Column, classification: Column) -> Column:
    """Surfaced but not flagged: NULL flag is 'not flagged'."""
    return (~F.coalesce(flagged, F.lit(False))) & F.coalesce(
        classification.isin(*CATCH_CLASSES), F.lit(False))


def with_status(rows: DataFrame) -> DataFrame:
    """Add ``ai_catch`` and the per-row label Yes / AI catch / No."""
    catch = is_catch(F.col("technician_flagged"), F.col("classification"))
    return rows.withColumn("ai_catch", catch).withColumn(
        "status",
        F.when(F.coalesce(F.col("technician_flagged"), F.lit(False)), F.lit("Yes"))
         .when(catch, F.lit("AI catch"))
         .otherwise(F.lit("No")))


def restrict_components(rows: DataFrame, selected: list[str] | DataFrame) -> DataFrame:
    """Keep rows whose component is selected. A list becomes an IN filter;
    a key table is a left-semi join (broadcast by AQE when small)."""
    if isinstance(selected, DataFrame):
        keys = selected.select(F.col(selected.columns[0]).alias("component_key"))
        return rows.join(keys, "component_key", "left_semi")
    return rows.filter(F.col("component_key").isin(*selected))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per group of ``keys`` (NULL keys form a group): the last by the
    ``order`` columns, compared one after the other, NULL before any value.

    A window with a limit of one row: Spark cuts each map task's rows down to
    one per key before the exchange, so the payload is shuffled once, and a
    hot key sends no more rows than there are map tasks."""
    last_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_place", F.row_number().over(last_first)).where("_place = 1").drop("_place")


def dedupe_latest(rows: DataFrame, seq_col: str | None = None, pos_col: str = "pos",
                  extra: list[str] | None = None) -> DataFrame:
    """One row per (service_id, component_key): the later one wins.

    'Later' is (``seq_col``, ``pos_col``): run order, then position in the
    answer, of any size; a NULL run or position comes before all others. Rows
    of one run and position are ordered by class, then reasoning."""
    cols = ["classification", "reasoning", *(extra or [])]
    seq = F.col(seq_col) if seq_col else F.lit(0)
    keyed = rows.select("service_id", "component_key", *cols, seq.alias("_run"), F.col(pos_col).alias("_pos"))
    return latest(keyed, ["service_id", "component_key"], ["_run", "_pos", "classification", "reasoning"]) \
        .select("service_id", "component_key", *cols)


OUTCOMES = ("no_answer", "unparsed", "empty", "ok")


def outcome() -> Column:
    """What became of a parsed answer: no_answer (NULL text), unparsed (bad
    JSON, truncated, fenced, wrong shape), empty (an empty list) or ok."""
    return (F.when(F.col("raw").isNull(), F.lit("no_answer"))
            .when(F.col("result.assessments").isNull(), F.lit("unparsed"))
            .when(F.size(F.col("result.assessments")) == 0, F.lit("empty"))
            .otherwise(F.lit("ok")))


def parse_status(scored: DataFrame) -> DataFrame:
    """Counts per outcome of parsing an answer (``outcome``), and of the assessments it gave."""
    n = F.size(F.col("result.assessments"))
    return (scored.select(outcome().alias("status"),
                          F.when(F.col("result.assessments").isNotNull(), n)
                           .otherwise(F.lit(0)).alias("n"))
            .groupBy("status")
            .agg(F.count(F.lit(1)).alias("services"), F.sum("n").cast("long").alias("assessments")))


#: A flat JSON object, its strings understood (possessive: no way back, whatever the length).
_ENTRY = r'\{[^{}"]*+(?:"(?:[^"\\]++|\\.)*+"[^{}"]*+)*+\}'
#: What an answer begins with, up to its list.
_HEAD = r'^\s*+\{\s*+"assessments"\s*+:\s*+\['


def answer_faults(df: DataFrame, raw_col: str = "raw", keep: tuple[str, ...] = ("service_id",)) -> DataFrame:
    """Why an answer's text gives no rows, and how far it is whole: ``fault``,
    ``whole_entries`` (before the first broken one) and ``broken_at`` (its place, from 0).

    no_answer (NULL), prose (no JSON at all), fenced (in a code fence: the entries
    counted are those inside), truncated (the text ends before its list does),
    bad_json, wrong_shape (JSON, but no list of objects under ``assessments``),
    empty (an empty list) and ok. Entries of valid JSON are objects of the list;
    in broken text they are read one after the other from its beginning."""
    text = F.col(raw_col)
    fenced = F.coalesce(text.rlike(r"^\s*+```"), F.lit(False))
    # Each step its own projection: the later ones use the earlier ones' columns more than once.
    rows = df.select(*keep, text.alias("_raw"), fenced.alias("_fenced"), F.when(fenced, json_text.strip_fence(text)).otherwise(text).alias("_text"))
    rows = rows.withColumn("_json", F.try_parse_json("_text"))
    rows = rows.withColumn("_list", F.try_variant_get("_json", "$.assessments", "array<variant>"))
    rows = rows.withColumn("_odd", F.array_position(F.transform("_list", lambda e: F.startswith(F.coalesce(F.schema_of_variant(e), F.lit("")), F.lit("OBJECT"))), False))
    body = F.regexp_replace("_text", _HEAD, "")
    rows = rows.withColumn("_body", F.when(F.col("_json").isNull() & F.col("_text").rlike(_HEAD), body))
    # Whole entries in a row, each with the comma after it, or at the end of the list.
    rows = rows.withColumn("_run", F.regexp_extract("_body", rf"^(?:\s*+{_ENTRY}\s*+(?:,|(?=\])|$))*+", 0))
    rows = rows.withColumn("_entries", F.transform(F.regexp_extract_all("_run", F.lit(f"({_ENTRY})")), F.try_parse_json))
    rows = rows.withColumn("_bad", F.array_position(F.transform("_entries", lambda e: e.isNull()), True))
    rows = rows.withColumn("_whole", F.when(F.col("_bad") > 0, F.col("_bad") - 1).otherwise(F.size("_entries")))
    # After the whole entries nothing: cut off between two of them.
    cut = F.coalesce(F.trim(F.substr("_body", F.char_length("_run") + 1)) == "", F.lit(False))
    n, odd = F.size("_list"), F.col("_odd") > 0
    ends = F.col("_text").rlike(r"[}\]]\s*+$")
    broken = (F.when(~F.col("_text").rlike(r"^\s*+[\[{]"), F.lit("prose")).when(ends & ~cut, F.lit("bad_json")).otherwise(F.lit("truncated")))
    fault = (F.when(F.col("_raw").isNull(), F.lit("no_answer")).when(F.col("_fenced"), F.lit("fenced"))
             .when(F.col("_json").isNull(), broken)
             .when(F.col("_list").isNull() | odd, F.lit("wrong_shape"))
             .when(n == 0, F.lit("empty")).otherwise(F.lit("ok")))
    whole = F.when(odd, F.col("_odd") - 1).when(F.col("_list").isNotNull(), n).otherwise(F.coalesce("_whole", F.lit(0)))
    place = F.when(odd, F.col("_odd") - 1).when(F.col("_body").isNotNull(), F.col("_whole"))
    return rows.select(*keep, fault.alias("fault"), whole.cast("int").alias("whole_entries"), place.cast("int").alias("broken_at"))


def contract_violations(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that break the answer contract: an expected key missing, a key
    not asked for, or a class outside the enum. Row-local (no join)."""
    expected = F.array(*[F.lit(k) for k in keys])
    got = F.coalesce(F.col("result.assessments"),
                     F.array().cast("array<struct<component:string,classification:string,reasoning:string>>"))
    comps = F.transform(got, lambda a: a["component"])
    missing = F.transform(F.array_except(expected, comps),
                          lambda k: F.struct(k.alias("component_key"), F.lit("missing").alias("violation")))
    extra = F.transform(F.filter(F.array_distinct(comps), lambda k: ~F.coalesce(F.array_contains(expected, k), F.lit(False))),
                        lambda k: F.struct(k.alias("component_key"), F.lit("unexpected").alias("violation")))
    bad = F.transform(F.filter(got, lambda a: ~F.coalesce(a["classification"].isin(*CLASSES), F.lit(False))),
                      lambda a: F.struct(a["component"].alias("component_key"),
                                         F.lit("bad_class").alias("violation")))
    return (explode_rows(scored, ["service_id"], F.concat(missing, extra, bad), val="v")
            .select("service_id", "v.component_key", "v.violation"))


def confusion(scored: DataFrame) -> DataFrame:
    """Predicted vs ground-truth class per component. Truth is the JSON in
    ``ground_truth``; a component absent from it had no signal, i.e. Good.
    The truth map is parsed once per row, below the explode (inside a
    lambda it would be parsed again for every component), then one small
    aggregation."""
    truth = F.from_json(F.col("ground_truth"), "map<string,string>")
    rows = explode_rows(scored.select(truth.alias("_truth"), "result"), ["_truth"],
                        F.col("result.assessments"), val="a")
    comp = F.col("a.component")
    return (rows.select(comp.alias("component_key"),
                        F.coalesce(F.element_at(F.col("_truth"), comp), F.lit("Good")).alias("truth"),
                        F.col("a.classification").alias("predicted"))
            .groupBy("component_key", "truth", "predicted")
            .agg(F.count(F.lit(1)).alias("n")))
