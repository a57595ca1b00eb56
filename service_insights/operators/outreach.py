"""Follow-up outreach for service visits with an Urgent finding.

Grain: one row per service visit (not per customer). Joins go
service -> vehicle (vehicle_id) -> customer (customer_id); visits without a
vehicle or customer drop out (inner joins). No join hints: AQE picks
broadcast only when a side's runtime size is under the broadcast threshold,
and splits skewed partitions of the sort-merge join otherwise.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EMAIL_PROMPT_INTRO, EMAIL_PROMPT_OUTRO
from ..functions.arrays import explode_rows


def urgent_reasons(recommendations: DataFrame) -> DataFrame:
    """(service_id, vehicle_id, urgent_reasons) over Urgent rows.

    Pieces are ``key: reasoning``; a NULL reasoning drops its piece, a group
    of only NULL pieces gives ''. Pieces are sorted so the text is stable.
    A group is one visit, so the collected list is bounded by the number of
    components in one answer."""
    piece = F.concat(F.col("component_key"), F.lit(": "), F.col("reasoning"))
    return (recommendations.filter(F.col("classification") == "Urgent")
            .groupBy("service_id", "vehicle_id")
            .agg(F.array_join(F.sort_array(F.collect_list(piece)), "; ").alias("urgent_reasons")))


def urgent_reasons_on_row(scored: DataFrame, answer: str = "result.assessments",
                          keep: tuple[str, ...] = ("service_id", "vehicle_id")) -> DataFrame:
    """:func:`urgent_reasons` from answers held on the service's row, for a
    frame with one row per service (the derived ``service`` table): same
    pieces, same order, same rows, with no explode and no shuffle.

    The Urgent entries are one column in their own projection (the lambda
    is not re-run for each use). Visits without one are dropped through
    ``explode_rows`` of a 0-or-1 element array, which the optimizer cannot
    push below the scorer as it would a plain Filter."""
    urgent = F.filter(F.col(answer),
                      lambda a: F.coalesce(a["classification"] == "Urgent", F.lit(False)))
    u = scored.select(*keep, urgent.alias("_urgent"))
    pieces = F.filter(F.transform(F.col("_urgent"), lambda a: F.concat(
        a["component"], F.lit(": "), a["reasoning"])), lambda p: p.isNotNull())
    text = F.when(F.size(F.col("_urgent")) > 0,
                  F.array(F.array_join(F.sort_array(pieces), "; ")))
    return explode_rows(u.select(*keep, text.alias("_text")), list(keep), F.col("_text"),
                        val="urgent_reasons")


def urgent_findings(recommendations: DataFrame, vehicle: DataFrame, customer: DataFrame) -> DataFrame:
    """Urgent visits joined through vehicle to customer."""
    return join_findings(urgent_reasons(recommendations), vehicle, customer)


#: Shares of the vehicles that a full run drafts its emails in.
SLICES = 6


def urgent_findings_in_slices(recommendations: DataFrame, vehicle: DataFrame, customer: DataFrame,
                              slices: int = SLICES) -> Iterator[DataFrame]:
    """:func:`urgent_findings` as one frame for each share of the vehicles; together they have its rows.

    Grouping and joining shuffle the reasons' texts three times. Written one after
    the other, the frames have a share of those files on disk at a time, and read
    the recommendations once each. All of a vehicle's visits are in one share."""
    share = F.pmod(F.xxhash64("vehicle_id"), F.lit(slices))
    # Equal ids of two types are joined, but their hashes differ: such vehicles are in every share.
    alike = recommendations.schema["vehicle_id"].dataType == vehicle.schema["vehicle_id"].dataType
    urgent = recommendations.filter(F.col("classification") == "Urgent")
    for i in range(slices):
        yield urgent_findings(urgent.filter(share == i), vehicle.filter(share == i) if alike else vehicle, customer)


def join_findings(u: DataFrame, vehicle: DataFrame, customer: DataFrame) -> DataFrame:
    """(service_id, vehicle_id, urgent_reasons) joined through vehicle to customer."""
    v = vehicle.select("vehicle_id", "customer_id", "make", "model")
    c = customer.select("customer_id", "first_name", "last_name", "email")
    return (u.join(v, "vehicle_id", "inner").join(c, "customer_id", "inner")
            .select("service_id", "vehicle_id", "customer_id", "first_name", "last_name",
                    "email", "make", "model", "urgent_reasons"))


def email_prompt() -> Column:
    """Prompt for drafting one email; any NULL part gives a NULL prompt."""
    return F.concat(F.lit(EMAIL_PROMPT_INTRO), F.lit("Customer: "), F.col("first_name"), F.lit(" "),
                    F.col("last_name"), F.lit(". Vehicle: "), F.col("make"), F.lit(" "),
                    F.col("model"), F.lit(". Findings needing attention: "),
                    F.col("urgent_reasons"), F.lit(EMAIL_PROMPT_OUTRO))


def email_prompts(findings: DataFrame) -> DataFrame:
    return findings.select("service_id", "customer_id", email_prompt().alias("email_prompt"))


def template_email() -> Column:
    """Offline stand-in for the drafted email (NULL in, NULL out)."""
    return F.concat(
        F.lit("Dear "), F.col("first_name"), F.lit(" "), F.col("last_name"),
        F.lit(",\n\nThank you for bringing your "), F.col("make"), F.lit(" "), F.col("model"),
        F.lit(" in for service. Our technician found items that need attention soon: "),
        F.col("urgent_reasons"),
        F.lit(".\n\nPlease reply to this message to schedule the work at a time that suits you."
              "\n\nBest regards,\nYour service team"))


def followup_emails(findings: DataFrame, drafter=None, partitions: int | None = None,
                    error_col: str | None = None, ledger=None) -> DataFrame:
    """Add ``custom_email`` to every urgent visit: the template, or a model
    call per visit through ``drafter`` (an EndpointScorer in text mode).

    ``error_col`` tells why a draft is missing (NULL where there is one, and
    where a NULL part leaves no prompt to send). With a ``ledger`` each prompt
    is sent once, however often this runs."""
    if drafter is None:
        out = findings.withColumn("custom_email", template_email())
        return out.withColumn(error_col, F.lit(None).cast("string")) if error_col else out
    prompted = findings.withColumn("_prompt", email_prompt())
    if ledger is not None:
        from .ledger import answered
        drafted = answered(prompted, ledger, drafter, "_prompt", out_col="custom_email", error_col="_error", partitions=partitions)
        drafted = drafted.withColumn(error_col, F.col("_error")) if error_col else drafted
        return drafted.drop("_prompt", "_error")
    from .scoring import score_python
    return score_python(prompted, drafter.client, "_prompt", partitions, out_col="custom_email", error_col=error_col,
                        per_second=getattr(drafter, "per_second", 0.0)).drop("_prompt")
