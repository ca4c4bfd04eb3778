"""Plans that advance as step results arrive: the state of a plan is kept by the engine under its id."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mailloom import rules
from mailloom.streaming.state import keep_state_on_disk

#: What a plan reports after each micro-batch that touched it.
PROGRESS = (
    "plan_id {key}, version long, step_index long, type string, route string, completed long, artifacts array<string>, "
    "repeated array<long>, orphans array<long>"
)


#: A plan as it is kept: its version, its steps, their results, and the steps whose result came again.
PLAN = (
    "version long, steps array<long>, statuses array<string>, types array<string>, done array<long>, artifacts array<array<string>>, "
    "repeated array<long>"
)


class PlanProgress(StatefulProcessor):
    """Steps and results of one plan, in whatever order they come.

    A step may come before or after its result. A second, different row of a step
    that is known replaces nothing: the first announcement counts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.plan = handle.getValueState("plan", PLAN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # One read and one write of the plan: each access to the state is a call of the engine.
        version, known, statuses, kinds, done, artifacts, again = self.plan.get() or (0, *([] for _ in range(6)))
        steps = {k: (status, kind) for k, status, kind in zip(known, statuses, kinds)}
        results = {k: list(a) for k, a in zip(done, artifacts)}
        again, version = list(again), version + 1
        for row in rows:
            if row["artifacts"] is None:
                steps.setdefault(row["step_index"], (row["status"], row["type"]))
            elif row["step_index"] in results:
                again.append(row["step_index"])
            else:
                results[row["step_index"]] = list(row["artifacts"])
        kept = ([s for s, _ in steps.values()], [k for _, k in steps.values()], list(results), list(results.values()))
        self.plan.update((version, list(steps), *kept, again))
        pending = sorted(k for k, (status, _) in steps.items() if status == rules.STEP_PENDING and k not in results)
        done = sum(status == rules.STEP_COMPLETED or k in results for k, (status, _) in steps.items())
        yield Row(
            plan_id=key[0],
            version=version,
            step_index=pending[0] if pending else None,
            type=steps[pending[0]][1] if pending else None,
            route=rules.ROUTE_DISPATCH if pending else rules.ROUTE_SHUTDOWN,
            completed=done,
            artifacts=[a for k in sorted(results) for a in results[k]],
            repeated=sorted(again),
            orphans=sorted(results.keys() - steps.keys()),
        )

    def close(self) -> None:
        pass


def advance(events: DataFrame) -> DataFrame:
    """Where every plan stands after each micro-batch that brought something for it.

    ``events`` is a stream of ``plan_id, step_index, type, status, artifacts``. Rows
    without artifacts announce a step; rows with them, also an empty list, are the
    result of a step and complete it. The state of a plan has its steps, their
    results and a version; nothing else is kept, and no row of an earlier batch is
    read again.

    A row has the next pending step (NULL if there is none) with its type, the
    route, the number of completed steps, the artifacts so far in step order,
    the steps whose result came more than once (the first counts), and those whose
    result came without a step so far. Rows without plan or step are left out.
    """
    keep_state_on_disk(events.sparkSession)
    named = events.filter("plan_id is not null and step_index is not null").select(
        "plan_id", F.col("step_index").cast("long").alias("step_index"), "type", "status", F.col("artifacts").cast("array<string>").alias("artifacts")
    )
    schema = PROGRESS.format(key=named.schema["plan_id"].dataType.simpleString())
    return named.groupBy("plan_id").transformWithState(
        PlanProgress(), outputStructType=schema, outputMode="Append", timeMode="None"
    )


def standing(progress: DataFrame) -> DataFrame:
    """The last row of each plan among all that ``advance`` has reported."""
    last = Window.partitionBy("plan_id").orderBy(F.desc("version"))
    return progress.withColumn("__rank", F.row_number().over(last)).filter("__rank = 1").drop("__rank", "version")
