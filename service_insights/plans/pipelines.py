"""Composite jobs: a test run of a config (C1), a comparison of two configs
(C2) and the full-table run with outreach (C5)."""
from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..constants import COMPONENT_KEYS, SEED_COMPONENTS
from ..functions.json_text import output_prefix
from ..functions.rules import BALANCED, STRICT, Thresholds, with_signals
from ..operators import answers, assess, ledger, outreach, scoring
from ..sources import catalog, registry


def catalog_entry(key: str) -> dict:
    for k, name, desc, rubric, order in SEED_COMPONENTS:
        if k == key:
            return {"component_key": k, "display_name": name, "description": desc,
                    "rubric": rubric, "sort_order": order}
    return {"component_key": key, "display_name": key, "description": "", "rubric": ""}


@dataclass
class Config:
    """A prompt configuration: components in order, prompt, thresholds of
    the offline scorer."""
    config_id: str
    name: str
    components: list[dict]
    model_endpoint: str = "rules"
    prompt_text: str | None = None
    thresholds: Thresholds = BALANCED
    description: str = ""
    extra: dict = field(default_factory=dict)

    @property
    def keys(self) -> list[str]:
        return [c["component_key"] for c in self.components]


def seed_configs() -> dict[str, Config]:
    demo = [catalog_entry("tires"), catalog_entry("brakes")]
    every = [catalog_entry(k) for k in COMPONENT_KEYS]
    return {
        "balanced": Config("c0000000balanced", "balanced", demo, thresholds=BALANCED),
        "strict": Config("c00000000strict", "strict", demo, thresholds=STRICT),
        "all_components": Config("c000000000every", "all components", every, thresholds=BALANCED),
        "all_strict": Config("c00000allstrict", "all components strict", every, thresholds=STRICT),
    }


def restrict_config(config: Config, selected: list[str]) -> Config:
    """The config with only the selected components, in config order."""
    keep = set(selected)
    return replace(config, components=[c for c in config.components if c["component_key"] in keep])


def sample(service: DataFrame, limit: int | None) -> DataFrame:
    """``ORDER BY service_id LIMIT n`` (a top-n, no global sort; 0 gives no
    rows) or the whole table when ``limit`` is None; NULL flags become []."""
    base = service.select("service_id", "vehicle_id", "service_type", "service_performed",
                          assess.flagged_array().alias("flagged_components"), "ground_truth")
    return base.orderBy("service_id").limit(int(limit)) if limit is not None else base


def _fan_out(df: DataFrame, limit: int | None) -> int:
    return scoring.full_run_partitions(df.sparkSession) if limit is None else scoring.sample_partitions(limit)


def run_config(service: DataFrame, config: Config, limit: int | None = 50, scorer=None,
               partitions: int | None = None, with_pos: bool = False,
               components: list[str] | None = None) -> DataFrame:
    """C1: sample -> score -> parse -> explode -> flag. Unordered; order at
    the edge with ``orderBy('service_id', 'component_key')``."""
    if not config.components:
        raise ValueError("select at least one component")
    scorer = scorer or scoring.RuleScorer(config.thresholds)
    base = sample(service, limit)
    if partitions is None and not isinstance(scorer, scoring.RuleScorer):
        partitions = _fan_out(base, limit)
    scored = scoring.score(base, config.keys, scorer, partitions=partitions)
    return assess.explode_assessments(scored, with_pos=with_pos, components=components)


def compare_configs(service: DataFrame, a: Config, b: Config, limit: int | None = 50,
                    scorer_a=None, scorer_b=None, partitions: int | None = None) -> DataFrame:
    """C2: both configs score the same sampled rows in one pass (the sample
    is read once) and the two answers are compared on each row. The table
    must have one row per service id, as the derived one has; stored runs
    with repeated ids are compared by ``compare.compare_rows``."""
    scorer_a = scorer_a or scoring.RuleScorer(a.thresholds)
    scorer_b = scorer_b or scoring.RuleScorer(b.thresholds)
    python = not (isinstance(scorer_a, scoring.RuleScorer) and isinstance(scorer_b, scoring.RuleScorer))
    base = sample(service, limit)
    if partitions is None and python:
        partitions = _fan_out(base, limit)
    if python and partitions:
        base = base.repartition(int(partitions))
    if not python:
        # Both rule configs read one extraction of the notes.
        base, _ = with_signals(base, [*a.keys, *b.keys], "service_performed")
    sa = scoring.score(base, a.keys, scorer_a, result_col="result_a", raw_col="raw_a")
    sb = scoring.score(sa, b.keys, scorer_b, result_col="result_b", raw_col="raw_b")
    # Both answers sit on the service's row: compared there, no shuffle.
    out = answers.compare_answers(sb, "result_a.assessments", "result_b.assessments",
                                  keep=["service_id", "service_performed"])
    return out.select("service_id", "component_key", "service_performed", "a_classification",
                      "a_reasoning", "b_classification", "b_reasoning", "differs")


def recommendations(service: DataFrame, config: Config, scorer=None,
                    partitions: int | None = None, where=None) -> DataFrame:
    """First half of C5: every service row scored, one row per component."""
    scorer = scorer or scoring.RuleScorer(config.thresholds)
    if partitions is None and not isinstance(scorer, scoring.RuleScorer):
        partitions = scoring.full_run_partitions(service.sparkSession)
    scored = scoring.score(service, config.keys, scorer, partitions=partitions)
    return assess.explode_assessments(
        scored, keep=["service_id", "vehicle_id", "service_performed"], where=where)


def full_run(spark: SparkSession, service: DataFrame, vehicle: DataFrame, customer: DataFrame,
             config: Config, out_dir: str, scorer=None, drafter=None, partitions: int | None = None,
             max_failed: float = 0.0, database: str = "default", slices: int = ledger.SLICES) -> dict:
    """C5: score the whole table, draft one email per urgent visit, and publish
    answers, recommendations and emails as tables of ``database``.

    What a model answers goes to a ledger below ``out_dir`` first, slice by
    slice. A run that was killed or refused half-way is run again: it sends only
    what has no answer yet. Where more than ``max_failed`` of the sent rows (or
    drafts) have no answer, nothing is published: the last good tables stay, and
    the ledger tells why. All three tables are written to fresh folders before
    the first of them is switched over, one catalog change each."""
    prefix = spark.range(1).select(output_prefix(F.lit(config.name), F.lit(config.config_id))).first()[0]
    base = f"{out_dir.rstrip('/')}/{prefix}"
    names = {what: f"{database}.`{prefix}_{what}`" for what in ("answers", "recommendations", "emails")}
    paid = scorer is not None and not isinstance(scorer, scoring.RuleScorer)
    if partitions is None and (paid or drafter is not None):
        partitions = scoring.full_run_partitions(spark)
    rows = service.select("service_id", "vehicle_id", "service_performed",
                          assess.flagged_array().alias("flagged_components"))
    if paid:
        raw = ledger.answered(rows, ledger.Ledger(spark, f"{base}_ledger"), scorer, "service_performed", partitions=partitions, slices=slices)
    else:
        raw = scoring.score(rows, config.keys, scorer or scoring.RuleScorer(config.thresholds, as_text=True)).drop("result")
        raw = raw.withColumn("error", F.lit(None).cast("string"))
    staged = {"answers": registry.stage(raw, f"{base}_answers", level=7)}
    answers_ = spark.read.parquet(staged["answers"])
    sent = answers_.where("service_performed is not null").agg(F.count("*").alias("n"), F.count("raw").alias("got")).first()
    _enough(sent["n"] - sent["got"], sent["n"], max_failed, "calls", f"{base}_ledger")
    # The outcomes are counted on the way to the recommendations: each answer is parsed once.
    counted = Observation()
    kept = scoring.parsed(answers_).observe(counted, *[
        F.count_if(F.col("service_performed").isNotNull() & (assess.outcome() == s)).alias(s) for s in assess.OUTCOMES])
    recs = assess.explode_assessments(kept, keep=["service_id", "vehicle_id", "service_performed"])
    staged["recommendations"] = registry.stage(recs, f"{base}_recommendations", level=6)
    status = {s: n for s, n in counted.get.items() if n}
    # Calls to a drafter have slices of their own, in the ledger.
    shares = outreach.SLICES if drafter is None else 1
    findings = outreach.urgent_findings_in_slices(spark.read.parquet(staged["recommendations"]), vehicle, customer, shares)
    drafts = ledger.Ledger(spark, f"{base}_drafts") if drafter is not None else None
    staged["emails"] = registry.stage((outreach.followup_emails(f, drafter, partitions, "error", drafts) for f in findings), f"{base}_emails")
    emails = spark.read.parquet(staged["emails"])
    drafted = emails.agg(F.count("*").alias("n"), F.count("error").alias("failed")).first()
    _enough(drafted["failed"], drafted["n"], max_failed, "drafts", f"{base}_drafts")
    for what, path in staged.items():
        registry.switch(spark, names[what], path)
    return {**names, "status": status, "n_recommendations": spark.table(names["recommendations"]).count(),
            "n_emails": drafted["n"], "failed_drafts": drafted["failed"]}


def _enough(failed: int, sent: int, max_failed: float, what: str, where: str) -> None:
    if failed > max_failed * sent:
        raise RuntimeError(f"{failed} of {sent} {what} gave no answer; nothing was published ({where} has them)")


def persist_run(spark: SparkSession, rows: DataFrame, out_dir: str, config: Config, limit: int | None,
                source_table: str = "service") -> str:
    """S9: append a run row and its result rows; returns the run id."""
    run_id = uuid.uuid4().hex
    run, results = catalog.run_rows(spark, rows, run_id, config.config_id, config.name,
                                    config.model_endpoint, source_table, limit)
    registry.append(results, f"{out_dir.rstrip('/')}/run_results")
    registry.append(run, f"{out_dir.rstrip('/')}/runs")
    return run_id


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """O2, O5: result order at the edge, NULL keys first."""
    return rows.orderBy(*[F.col(k).asc_nulls_first() for k in (keys or ("service_id", "component_key"))])
