"""Registered queries: one callable per operator key, each taking
``(spark, sf_dir)`` and returning a lazy DataFrame over the whole derived
tables. Their DuckDB oracles live in ``plans.oracle``."""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import NOTES_SEPARATOR
from ..functions import json_text, rules
from ..operators import answers, assess, compare, ledger, outreach, prompts, scoring, summarize
from ..sources import catalog, fixtures, generate, keyed, registry, run_counts, scratch
from ..sources.tables import read_table
from . import pipelines

CONFIGS = pipelines.seed_configs()
SELECTED = ["battery", "ac", "wipers"]
RUN_ID = "run-0001"


def _service(spark, sf):
    return fixtures.service(spark, sf)


def sample_services(spark: SparkSession, sf: str) -> DataFrame:
    s = pipelines.sample(_service(spark, sf), 50)
    return s.select("service_id", "service_type", "service_performed",
                    F.array_join("flagged_components", ",").alias("flagged_keys"))


def extract_readings(spark, sf):
    s = _service(spark, sf).select("service_id", "service_performed")
    return rules.readings(s).drop("service_performed")


def rule_severity(spark, sf):
    rows = pipelines.run_config(_service(spark, sf), CONFIGS["all_components"], limit=None)
    return rows.select("service_id", "component_key", "classification", "reasoning")


def score_notes(spark, sf):
    cfg = CONFIGS["balanced"]
    rows = pipelines.run_config(_service(spark, sf), cfg, limit=None,
                                scorer=scoring.RuleScorer(cfg.thresholds, as_text=True))
    return rows.select("service_id", "component_key", "classification")


def assessments(spark, sf):
    return pipelines.run_config(_service(spark, sf), CONFIGS["all_components"], limit=None)


def _balanced_rows(spark, sf):
    return pipelines.run_config(_service(spark, sf), CONFIGS["balanced"], limit=None)


def ai_catches(spark, sf):
    return assess.with_status(_balanced_rows(spark, sf)).select(
        "service_id", "component_key", "classification", "technician_flagged", "ai_catch", "status")


def catch_count(spark, sf):
    return summarize.catch_count(_balanced_rows(spark, sf))


def run_config(spark, sf):
    return _balanced_rows(spark, sf)


def distribution(spark, sf):
    return summarize.distribution(assessments(spark, sf))


def distribution_share(spark, sf):
    return summarize.distribution_share(assessments(spark, sf))


def distribution_pivot(spark, sf):
    return summarize.distribution_pivot(assessments(spark, sf))


def dedupe_assessments(spark, sf):
    """Latest assessment per (service, component) over two runs: a full
    balanced run, then a strict run of tires and brakes that overrides it.
    Both runs score the same scan, so the dedupe is row-local."""
    s = pipelines.sample(_service(spark, sf), None)
    first, second = CONFIGS["all_components"], CONFIGS["strict"]
    s1 = scoring.score(s, first.keys, scoring.RuleScorer(first.thresholds), result_col="r1")
    s2 = scoring.score(s1, second.keys, scoring.RuleScorer(second.thresholds), result_col="r2")
    return answers.dedupe_runs(s2, ["r1.assessments", "r2.assessments"], keep=["service_id"])


def compare_rows(spark, sf):
    return pipelines.compare_configs(_service(spark, sf), CONFIGS["balanced"], CONFIGS["strict"],
                                     limit=None)


def compare_diffs_only(spark, sf):
    return compare.diffs_only(compare_rows(spark, sf))


def compare_summary(spark, sf):
    return summarize.compare_summary(compare_rows(spark, sf))


def recommendations(spark, sf):
    return pipelines.recommendations(_service(spark, sf), CONFIGS["all_components"])


def urgent_findings(spark, sf):
    # The derived service table has one row per service, so the Urgent
    # reasons are joined on the service's row: no explode, no group-by
    # shuffle. (``outreach.urgent_findings`` groups stored recommendations.)
    cfg = CONFIGS["all_components"]
    scored = scoring.score(_service(spark, sf), cfg.keys, scoring.RuleScorer(cfg.thresholds))
    return outreach.join_findings(outreach.urgent_reasons_on_row(scored),
                                  fixtures.vehicle(spark, sf), fixtures.customer(spark, sf))


def email_prompts(spark, sf):
    return outreach.email_prompts(urgent_findings(spark, sf))


def followup_emails(spark, sf):
    return outreach.followup_emails(urgent_findings(spark, sf))


def full_run_emails(spark, sf):
    """C5: the whole run into published tables, and the emails as their readers see them."""
    out = pipelines.full_run(spark, _service(spark, sf), fixtures.vehicle(spark, sf), fixtures.customer(spark, sf),
                             CONFIGS["all_components"], scratch.folder(spark, "full-run"))
    return spark.table(out["emails"]).drop("error")


def echo_notes(body: dict) -> dict:
    """Stands for an endpoint: one assessment, whose reasoning is the beginning of the notes."""
    notes = body["messages"][0]["content"].split(NOTES_SEPARATOR, 1)[1]
    text = json.dumps({"assessments": [{"component": "tires", "classification": "Good", "reasoning": notes[:24]}]})
    return {"choices": [{"message": {"content": text}}]}


def ledger_answers(spark, sf):
    """L1, L3, L4: a run over a third of the services, then one over all, which sends the rest; rows from the answers kept."""
    rows = _service(spark, sf).select("service_id", "service_performed", "flagged_components")
    scorer = scoring.EndpointScorer("local", "echo", transport=echo_notes)
    book = ledger.Ledger(spark, scratch.folder(spark, "ledger"))
    ledger.answered(rows.where("service_id % 3 = 0"), book, scorer, "service_performed", slices=2)
    scored = scoring.parsed(ledger.answered(rows, book, scorer, "service_performed", slices=2))
    return assess.explode_assessments(scored, keep=["service_id"])


def run_results(spark, sf):
    cfg = CONFIGS["balanced"]
    _, results = catalog.run_rows(spark, _balanced_rows(spark, sf), RUN_ID, cfg.config_id, cfg.name,
                                  cfg.model_endpoint, "service", None)
    return results


def selected_components(spark, sf):
    """P7: only the selected components are scored (the selection is the
    config's component list), so the other nine are never evaluated."""
    cfg = pipelines.restrict_config(CONFIGS["all_components"], SELECTED)
    rows = pipelines.run_config(_service(spark, sf), cfg, limit=None)
    return rows.select("service_id", "component_key", "classification", "reasoning")


# Vehicle-dimension batches for the merge operators: the table as loaded up
# to 1998, and a batch of vehicles seen from 1998 on (overlapping one year),
# carrying a new model year.
def _orders_between(spark, sf, lo=None, hi=None):
    o = read_table(spark, sf, "orders")
    if lo:
        o = o.filter(F.col("o_orderdate") >= F.lit(lo).cast("timestamp_ntz"))
    if hi:
        o = o.filter(F.col("o_orderdate") < F.lit(hi).cast("timestamp_ntz"))
    return o


def _vehicle_target(spark, sf):
    return fixtures.vehicle_from_orders(_orders_between(spark, sf, hi="1999-01-01"))


def _vehicle_batch(spark, sf):
    v = fixtures.vehicle_from_orders(_orders_between(spark, sf, lo="1998-01-01"))
    return v.withColumn("year", (F.col("year") + 1).cast("int"))


def merge_insert_only(spark, sf):
    return registry.merge_insert_only(_vehicle_target(spark, sf), _vehicle_batch(spark, sf),
                                      ["vehicle_id"])


def merge_upsert(spark, sf):
    return registry.merge_upsert(_vehicle_target(spark, sf), _vehicle_batch(spark, sf),
                                 ["vehicle_id"])


def delete_by_keys(spark, sf):
    closed = read_table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F") \
        .select(F.col("o_orderkey").alias("vehicle_id"))
    return registry.delete_by_keys(fixtures.vehicle(spark, sf), closed, ["vehicle_id"])


def table_status(spark, sf):
    return registry.table_status(spark, {k: f(spark, sf) for k, f in fixtures.DERIVED.items()})


# Answers of a model with defects in every row's own way (``fixtures.responses``).
def _stored(spark, sf, run=0):
    """Rows of a stored run: its answers, cleaned, one row per component."""
    answers_ = scoring.parsed(fixtures.responses(spark, sf, run), clean=True)
    return assess.explode_assessments(answers_, keep=["service_id", "vehicle_id"], with_pos=True)


def clean_responses(spark, sf):
    return _stored(spark, sf).select("service_id", "component_key", "classification", "reasoning")


def parse_status(spark, sf):
    return assess.parse_status(scoring.parsed(fixtures.responses(spark, sf)))


def contract_violations(spark, sf):
    return assess.contract_violations(scoring.parsed(fixtures.responses(spark, sf)),
                                      list(fixtures.RESPONSE_KEYS[0]))


def response_distribution(spark, sf):
    return summarize.distribution(_stored(spark, sf))


def dedupe_stored(spark, sf):
    both = _stored(spark, sf, 0).withColumn("run", F.lit(0)).unionByName(
        _stored(spark, sf, 1).withColumn("run", F.lit(1)))
    return assess.dedupe_latest(both, seq_col="run")


def compare_stored(spark, sf):
    compared = compare.compare_keyed(_stored(spark, sf, 0), _stored(spark, sf, 1))
    return compare.with_notes(compared, _service(spark, sf))


def urgent_findings_stored(spark, sf):
    """Stored rows grouped by visit; visits of vehicles not loaded yet drop out."""
    return outreach.urgent_findings(_stored(spark, sf), _vehicle_target(spark, sf), fixtures.customer(spark, sf))


def answer_faults(spark, sf):
    return assess.answer_faults(fixtures.responses(spark, sf))


def _added_runs(spark, sf):
    path = scratch.folder(spark, "run-counts")
    for run in (0, 1):
        run_counts.add(_stored(spark, sf, run), f"run-{run}", path)
    return run_counts.read(spark, path)


def runs_distribution(spark, sf):
    """Two stored runs, each counted when it was added."""
    return summarize.distribution_share(_added_runs(spark, sf), weight="n")


def runs_pivot(spark, sf):
    return summarize.distribution_pivot(_added_runs(spark, sf), weight="n")


def runs_catches(spark, sf):
    return summarize.catch_count(_added_runs(spark, sf), weight="n")


def runs_compare_totals(spark, sf):
    """Two comparisons, each kept as its totals."""
    path = scratch.folder(spark, "compared")
    for a, b in ((0, 1), (0, 0)):
        run_counts.add_comparison(compare.compare_keyed(_stored(spark, sf, a), _stored(spark, sf, b)), f"run-{a}", f"run-{b}", path)
    return run_counts.compare_totals(spark, path)


def _vehicle_table(spark, rows):
    table = keyed.KeyedTable(spark, scratch.folder(spark, "vehicle"), ["vehicle_id"])
    table.create(rows)
    return table


def upsert_stored(spark, sf):
    table = _vehicle_table(spark, _vehicle_target(spark, sf))
    table.upsert(_vehicle_batch(spark, sf))
    return table.read()


def insert_stored(spark, sf):
    table = _vehicle_table(spark, _vehicle_target(spark, sf))
    table.insert_new(_vehicle_batch(spark, sf))
    return table.read()


def delete_stored(spark, sf):
    table = _vehicle_table(spark, fixtures.vehicle(spark, sf))
    table.delete(read_table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("vehicle_id")))
    return table.read()


def urgent_findings_bucketed(spark, sf, buckets: int = 16):
    """Recommendations and vehicles stored by vehicle: neither the group-by nor the first join shuffles."""
    def stored(rows, what):
        path = scratch.folder(spark, what)
        return keyed.store_bucketed(rows, path.rsplit("/", 1)[-1].replace("-", "_"), "vehicle_id", buckets, path)

    recs = stored(_stored(spark, sf).select("service_id", "vehicle_id", "component_key", "classification", "reasoning"), "recommendations")
    return outreach.urgent_findings(recs, stored(_vehicle_target(spark, sf), "vehicles"), fixtures.customer(spark, sf))


def stored_status(spark, sf):
    """Tables as they are stored, one of them missing."""
    paths = {"customer": f"{sf}/customer.parquet", "vehicle": f"{sf}/orders.parquet", "technician": f"{sf}/supplier.parquet", "service": f"{sf}/service.parquet"}
    return registry.stored_status(spark, paths)


def config_components(spark, sf):
    c = fixtures.configs(spark, sf).select("config_id", json_text.config_components(F.col("components")).alias("c"))
    return c.select("config_id", F.size("c").alias("n"),
                    F.array_join(F.transform("c", lambda x: x["component_key"]), ",").alias("keys"))


def composed_prompts(spark, sf):
    return prompts.composed_prompts(fixtures.configs(spark, sf)).select("config_id", "full_prompt")


def default_prompts(spark, sf):
    return prompts.default_prompts(fixtures.configs(spark, sf)).select("config_id", "default_prompt")


def output_prefixes(spark, sf):
    return fixtures.configs(spark, sf).select(
        "config_id", json_text.output_prefix(F.col("name"), F.col("config_id")).alias("output_prefix"))


def confusion(spark, sf):
    cfg = CONFIGS["all_strict"]
    scored = scoring.score(pipelines.sample(_service(spark, sf), None), cfg.keys,
                           scoring.RuleScorer(cfg.thresholds))
    return assess.confusion(scored)


def generate_sample(spark, sf):
    s = generate.services(spark, read_table(spark, sf, "customer").select("c_custkey"))
    return s.select("service_id", "vehicle_id", "technician_id", F.col("service_date").cast("string").alias("service_date"),
                    "service_type", "service_performed",
                    F.array_join("flagged_components", ",").alias("flagged_keys"), "ground_truth")


def generate_linked(spark, sf):
    """Every generated service with its vehicle's customer: none is dropped."""
    keys = read_table(spark, sf, "customer").select("c_custkey")
    t = generate.generate(spark, keys)
    return (t["service"].select("service_id", "vehicle_id").join(t["vehicle"].select("vehicle_id", "customer_id", "vin"), "vehicle_id")
            .join(t["customer"].select("customer_id", "phone"), "customer_id")
            .select("service_id", "vehicle_id", "customer_id", "vin", "phone"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sample_services": sample_services,
    "extract_readings": extract_readings,
    "rule_severity": rule_severity,
    "score_notes": score_notes,
    "assessments": assessments,
    "ai_catches": ai_catches,
    "catch_count": catch_count,
    "run_config": run_config,
    "distribution": distribution,
    "distribution_share": distribution_share,
    "distribution_pivot": distribution_pivot,
    "dedupe_assessments": dedupe_assessments,
    "compare_rows": compare_rows,
    "compare_diffs_only": compare_diffs_only,
    "compare_summary": compare_summary,
    "urgent_findings": urgent_findings,
    "email_prompts": email_prompts,
    "recommendations": recommendations,
    "followup_emails": followup_emails,
    "full_run_emails": full_run_emails,
    "ledger_answers": ledger_answers,
    "run_results": run_results,
    "selected_components": selected_components,
    "merge_insert_only": merge_insert_only,
    "merge_upsert": merge_upsert,
    "delete_by_keys": delete_by_keys,
    "table_status": table_status,
    "clean_responses": clean_responses,
    "parse_status": parse_status,
    "contract_violations": contract_violations,
    "response_distribution": response_distribution,
    "dedupe_stored": dedupe_stored,
    "compare_stored": compare_stored,
    "urgent_findings_stored": urgent_findings_stored,
    "answer_faults": answer_faults,
    "runs_distribution": runs_distribution,
    "runs_pivot": runs_pivot,
    "runs_catches": runs_catches,
    "runs_compare_totals": runs_compare_totals,
    "upsert_stored": upsert_stored,
    "insert_stored": insert_stored,
    "delete_stored": delete_stored,
    "urgent_findings_bucketed": urgent_findings_bucketed,
    "stored_status": stored_status,
    "config_components": config_components,
    "composed_prompts": composed_prompts,
    "default_prompts": default_prompts,
    "output_prefixes": output_prefixes,
    "confusion": confusion,
    "generate_sample": generate_sample,
    "generate_linked": generate_linked,
}
