"""Bookkeeping of multi-step plans held as an array of steps per plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom import rules


def _is_pending(step: Column) -> Column:
    return step.status == rules.STEP_PENDING


def next_pending(steps: Column) -> Column:
    """First pending step in list order, NULL if there is none."""
    return F.get(F.filter(steps, _is_pending), F.lit(0))


def mark_completed(steps: Column, position: Column) -> Column:
    """The steps with the one at a position completed; a missing position is an error."""
    done = F.transform(
        steps,
        lambda step, i: F.when(i == position, step.withField("status", F.lit(rules.STEP_COMPLETED))).otherwise(step),
    )
    outside = (position < 0) | (position >= F.size(steps))
    return F.when(outside, F.raise_error(F.lit("no step at this position"))).otherwise(done)


def route_after_dispatch(steps: Column) -> Column:
    """Dispatch again while a step is pending; an empty plan shuts down."""
    return F.when(F.exists(steps, _is_pending), rules.ROUTE_DISPATCH).otherwise(rules.ROUTE_SHUTDOWN)


def number_steps(plans: DataFrame) -> DataFrame:
    """Suggested steps as numbered pending rows; the confidence is dropped."""
    return plans.select("plan_id", "ordering_reason", F.posexplode("suggested_steps").alias("step_index", "step")).select(
        "plan_id",
        "ordering_reason",
        "step_index",
        F.lit(rules.STEP_PENDING).alias("status"),
        "step.type",
        "step.summary",
        "step.reason",
        "step.action_spec",
        F.array().cast("array<string>").alias("errors"),
    )


def numbered(suggested: Column) -> Column:
    """Suggested steps as the step array of a new plan, numbered by position."""
    return F.transform(
        suggested,
        lambda s, i: F.struct(
            F.lit(rules.STEP_PENDING).alias("status"),
            s.type.alias("type"),
            i.alias("step_index"),
            s.summary.alias("summary"),
            s.reason.alias("reason"),
            s.action_spec.alias("action_spec"),
            F.array().cast("array<string>").alias("errors"),
        ),
    )


def next_pending_rows(step_rows: DataFrame) -> DataFrame:
    """First pending step of every plan from step rows.

    A minimum per plan, combined on the map side: a plan of any length costs
    one row per task in the shuffle.
    """
    rest = [n for n in step_rows.columns if n != "plan_id"]
    first = F.min_by(F.struct(*rest), "step_index").alias("step")
    return step_rows.filter(F.col("status") == rules.STEP_PENDING).groupBy("plan_id").agg(first).select("plan_id", "step.*")


def route_rows(step_rows: DataFrame) -> DataFrame:
    """Where each plan of step rows goes next."""
    pending = F.count_if(F.col("status") == rules.STEP_PENDING) > 0
    return step_rows.groupBy("plan_id").agg(
        F.when(pending, rules.ROUTE_DISPATCH).otherwise(rules.ROUTE_SHUTDOWN).alias("route")
    )


def earlier_artifacts(results: Column) -> Column:
    """Artifacts of all earlier results in step order, as one array."""
    return F.flatten(F.transform(F.array_sort(results), lambda r: r.artifacts))


def artifact_rows(result_rows: DataFrame) -> DataFrame:
    """(plan_id, step_index, artifacts) rows flattened to one row per artifact.

    The order is in the columns (step_index, position), so no plan is gathered
    in one place.
    """
    return result_rows.select("plan_id", "step_index", F.posexplode("artifacts").alias("position", "artifact"))


def merge_results(left: Column, right: Column) -> Column:
    """Two maps of step results as one; a step present in both is an error."""
    return F.map_concat(left, right)


#: Queue of the steps whose type is missing or unknown.
UNKNOWN = "unknown"


def type_queues(steps: DataFrame) -> dict[str, DataFrame]:
    """One work queue per step type, and one for all other steps."""
    queues = {kind: steps.filter(F.col("type") == kind) for kind in rules.STEP_TYPES}
    known = F.coalesce(F.col("type").isin(*rules.STEP_TYPES), F.lit(False))
    return {**queues, UNKNOWN: steps.filter(~known)}


def wrong_values(steps: DataFrame) -> DataFrame:
    """Steps whose status or type is none of the known ones, with ``reason``."""
    known = lambda column, values: F.coalesce(F.col(column).isin(*values), F.lit(False))
    reason = F.when(~known("status", rules.STEP_STATES), "unknown status").when(
        ~known("type", rules.STEP_TYPES), "unknown type"
    )
    return steps.withColumn("reason", reason).filter("reason is not null")


def step_inputs(plans: DataFrame) -> DataFrame:
    """The next step of each unfinished plan with its queue and the artifacts so far.

    ``plans`` has plan_id, steps and results (array of step_index, artifacts). A
    step that sends an email gets the whole state of its plan as JSON for context.
    """
    step = next_pending(F.col("steps"))
    return (
        plans.withColumn("step", step)
        .filter(F.exists("steps", _is_pending))
        .select(
            "plan_id",
            F.col("step.type").alias("type"),
            F.col("step.step_index").alias("step_index"),
            F.col("step").alias("execution_plan_step_data"),
            F.when(F.col("step.type") == rules.STEP_TYPES[0], earlier_artifacts(F.col("results"))).alias("artifacts"),
            F.when(F.col("step.type") == rules.STEP_TYPES[1], F.to_json(F.struct(*plans.columns))).alias("reply_context"),
        )
    )


def match_capability(suggestions: DataFrame, capabilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unknown) suggestions by capability name."""
    name = "capability_name"
    known = capabilities.dropDuplicates([name])
    matched = suggestions.join(known, suggestions["suggested_capability_name"] == known[name])
    unknown = suggestions.join(known, suggestions["suggested_capability_name"] == known[name], "left_anti")
    return matched, unknown
