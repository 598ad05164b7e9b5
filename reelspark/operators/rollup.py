"""Roll-ups over workflows, tasks and exports.

Every roll-up is a keyed aggregate over boolean or extreme values, so partial results combine on the map
side and no task sees all children of a large workflow or project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "interrupted", "cancelled")
BROKEN = ("failed", "interrupted", "cancelled")
#: Goals that a workflow may have; their places are 0 to 2.
MAX_GOALS = 3


def _flag(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def rollup_workflows(goals: DataFrame, tasks: DataFrame) -> DataFrame:
    """Status per goal and workflow from their tasks -> one row per goal with ``workflow_status``.

    ``goals``: workflow_id, goal, status, error, n_drafts; ``tasks``: workflow_id, kind (analyze / export),
    goal, seq, status, error.
    """
    by_task = tasks.groupBy("workflow_id").agg(
        _flag(~F.col("status").isin(*TERMINAL)).alias("active"),
        F.max_by(F.struct("status", "error"), F.when(F.col("kind") == "analyze", F.col("seq"))).alias("analysis"),
    )
    exports = (
        tasks.where(F.col("kind") == "export")
        .groupBy("workflow_id", "goal")
        .agg(
            F.count(F.lit(1)).alias("n_exports"),
            F.bool_or(~F.col("status").isin(*TERMINAL)).alias("waiting"),
            F.bool_or(F.col("status").isin(*BROKEN)).alias("broken"),
            F.count_if(F.col("status") == "completed").alias("n_done"),
            F.max_by(F.struct("error"), F.when(F.col("status").isin(*BROKEN), F.col("seq"))).alias("last_error"),
        )
    )
    joined = goals.join(exports, ["workflow_id", "goal"], "left").join(by_task, "workflow_id", "left")
    exported = F.coalesce(F.col("n_exports"), F.lit(0)) > 0
    unrouted = ~exported & (F.col("n_drafts") == 0)
    analysis = F.col("analysis.status")
    status = (
        F.when(exported & F.col("waiting"), F.lit("rendering"))
        .when(exported & F.col("broken"), F.lit("failed"))
        .when(exported, F.lit("completed"))
        .when(unrouted & analysis.isin("queued", "running"), F.lit("analyzing"))
        .when(unrouted & analysis.isin(*BROKEN), analysis)
        .otherwise(F.col("status"))
    )
    own_error = F.coalesce(F.col("error"), F.lit(""))
    error = (
        F.when(exported & F.col("broken"), F.coalesce(F.col("last_error.error"), F.lit("")))
        .when(exported & ~F.col("waiting"), F.lit(""))
        .when(unrouted & analysis.isin(*BROKEN) & (own_error == ""), F.coalesce(F.col("analysis.error"), F.lit("")))
        .otherwise(own_error)
    )
    per_goal = joined.select(
        "workflow_id", "goal", status.alias("goal_status"), error.alias("goal_error"),
        F.coalesce(F.col("n_done"), F.lit(0)).alias("n_done"), exported.alias("exported"),
        F.coalesce("active", F.lit(False)).alias("active"), analysis.alias("analysis_status"),
    )
    per_workflow = per_goal.groupBy("workflow_id").agg(
        F.bool_or("active").alias("active"),
        F.bool_or((F.col("n_done") > 0) | (F.col("goal_status") == "completed")).alias("good"),
        F.bool_or(F.col("goal_status").isin(*BROKEN)).alias("bad"),
        F.max("analysis_status").alias("analysis_status"),
        F.bool_or("exported").alias("exported"),
    )
    overall = (
        F.when(F.col("active"), F.lit("running"))
        .when(F.col("bad") & F.col("good"), F.lit("partial"))
        .when(F.col("bad") & F.col("analysis_status").isin("cancelled", "interrupted"), F.col("analysis_status"))
        .when(F.col("bad"), F.lit("failed"))
        .otherwise(F.lit("completed"))
    )
    per_workflow = per_workflow.select(
        "workflow_id", overall.alias("workflow_status"), F.col("exported").alias("has_exports")
    )
    project = (
        F.when(F.col("workflow_status") == "running", F.lit("processing"))
        .when((F.col("workflow_status") == "completed") & F.col("has_exports"), F.lit("exported"))
        .when(F.col("workflow_status") == "completed", F.lit("drafts_ready"))
        .otherwise(F.col("workflow_status"))
    )
    return (
        per_goal.select("workflow_id", "goal", "goal_status", "goal_error")
        .join(per_workflow, "workflow_id")
        .withColumn("project_status", project)
        .drop("has_exports")
    )


def project_status(tasks: DataFrame) -> DataFrame:
    """Project status after its latest task that decides one (``project_id, kind, status, error, seq``)."""
    done = F.col("status") == "completed"
    status = (
        F.when(done & (F.col("kind") == "import"), F.lit("source_ready"))
        .when(done & (F.col("kind") == "analyze"), F.lit("drafts_ready"))
        .when(done & (F.col("kind") == "export"), F.lit("exported"))
        .when(~done & ~F.col("kind").isin("preview", "inspect"), F.col("status"))
    )
    message = F.when(done, F.lit("")).otherwise(F.coalesce(F.col("error"), F.lit("")))
    t = tasks.select("project_id", "seq", "kind", done.alias("done"), status.alias("status"), message.alias("error"))
    decides_error = F.col("done") | F.col("status").isNotNull()
    return t.groupBy("project_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"),
        F.max_by("error", F.when(decides_error, F.col("seq"))).alias("error"),
    )


def completed_exports(exports: DataFrame, tasks: DataFrame, ordered: bool = False) -> DataFrame:
    """Exports whose task completed; ``ordered`` adds newest first."""
    done = tasks.where(F.col("status") == "completed").select("task_id")
    kept = exports.join(done, "task_id", "left_semi")
    return kept.orderBy(F.col("seq").desc()) if ordered else kept


def draft_export_state(drafts: DataFrame, exports: DataFrame, tasks: DataFrame) -> DataFrame:
    """Export state of the saved revision of every draft.

    ``exports``: task_id, draft_id, revision, created_at; ``tasks``: task_id, kind, status, draft_id, revision,
    created_at (of the frozen draft).  Jobs are exports plus unfinished export tasks not already exported.
    """
    finished = exports.select("task_id", "draft_id", F.col("revision").alias("job_revision"), "created_at", F.lit("completed").alias("status"))
    open_tasks = (
        tasks.where((F.col("kind") == "export") & (F.col("status") != "completed") & F.col("draft_id").isNotNull())
        .join(exports.select("task_id"), "task_id", "left_anti")
        .select("task_id", "draft_id", F.col("revision").alias("job_revision"), "created_at", "status")
    )
    # reduced per (draft, revision, status) first: a draft with very many jobs joins as a few rows
    jobs = finished.unionByName(open_tasks).groupBy("draft_id", "job_revision", "status").agg(
        F.max(F.struct("created_at", "task_id")).alias("newest")
    )
    joined = drafts.select("draft_id", "revision").join(jobs, "draft_id", "left")
    now = F.col("job_revision") == F.col("revision")
    busy = now & F.col("status").isin("queued", "running")
    # newest job first; of equal times the larger task id
    facts = joined.groupBy("draft_id", "revision").agg(
        F.max_by("status", F.when(busy, F.col("newest"))).alias("active"),
        _flag(now & (F.col("status") == "completed")).alias("completed"),
        _flag(now & F.col("status").isin(*BROKEN)).alias("broken"),
        _flag((F.col("job_revision") < F.col("revision")) & (F.col("status") == "completed")).alias("previous"),
    )
    state = (
        F.when(F.col("active") == "queued", F.lit("queued"))
        .when(F.col("active") == "running", F.lit("rendering"))
        .when(F.col("completed"), F.lit("ready"))
        .when(F.col("broken"), F.lit("failed"))
        .when(F.col("previous"), F.lit("updated"))
        .otherwise(F.lit("draft"))
    )
    return facts.select("draft_id", "revision", state.alias("export_state"))


def _mode(c: str) -> Column:
    return F.substring_index(F.col(c), "-", 1)


def merge_candidates(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming candidates replace earlier ones of the same workflow and id prefix; others stay.

    Order column ``ord``: incoming first.
    """
    replaced = incoming.select("workflow_id", _mode("id").alias("__mode")).distinct()
    kept = previous.withColumn("__mode", _mode("id")).join(replaced, ["workflow_id", "__mode"], "left_anti").drop("__mode")
    return (
        incoming.withColumn("part", F.lit(0)).unionByName(kept.withColumn("part", F.lit(1)))
    )


def evidence_ownership(workflows: DataFrame, drafts: DataFrame, candidates: DataFrame) -> DataFrame:
    """``workflow_id, verdict`` for evidence saved before workflows kept their own copy.

    ``workflows``: workflow_id, project_id, draft_ids (array); ``drafts``: draft_id, project_id, scenes;
    ``candidates``: project_id, id, start_s, end_s.  none = nothing to recover; owned = the only workflow of
    its project and a scene matches by prefixed id and both bounds within 1 ms; ambiguous otherwise.
    """
    per_project = workflows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_workflows"))
    has_evidence = candidates.select("project_id").distinct().withColumn("has_evidence", F.lit(True))
    scenes = (
        workflows.select("workflow_id", "project_id", F.explode("draft_ids").alias("draft_id"))
        .join(drafts, ["project_id", "draft_id"])
        .select("workflow_id", "project_id", F.explode("scenes").alias("s"))
        .select(
            "workflow_id", "project_id", F.col("s.start_s").alias("s0"), F.col("s.end_s").alias("s1"),
            F.explode(F.array(*[F.concat(F.lit(p), F.col("s.id")) for p in ("subtitle-", "visual-")])).alias("id"),
        )
    )
    anchored = (
        scenes.join(candidates, ["project_id", "id"])
        .where((F.abs(F.col("start_s") - F.col("s0")) <= 0.001) & (F.abs(F.col("end_s") - F.col("s1")) <= 0.001))
        .select("workflow_id")
        .distinct()
        .withColumn("anchored", F.lit(True))
    )
    joined = (
        workflows.join(per_project, "project_id").join(has_evidence, "project_id", "left").join(anchored, "workflow_id", "left")
    )
    verdict = (
        F.when((F.coalesce(F.size("draft_ids"), F.lit(0)) == 0) | F.col("has_evidence").isNull(), F.lit("none"))
        .when((F.col("n_workflows") == 1) & F.col("anchored"), F.lit("owned"))
        .otherwise(F.lit("ambiguous"))
    )
    return joined.select("workflow_id", verdict.alias("verdict"))


def goal_failures(results: DataFrame) -> DataFrame:
    """``workflow_id, ord, goal, status, error`` -> overall status and ``goal: error; ...`` message.

    A workflow has at most three distinct goals, so the ordered list per workflow is tiny.
    """
    failed = F.col("status") == "failed"
    known = F.col("ord").between(0, MAX_GOALS - 1)
    text = F.concat(F.col("goal"), F.lit(": "), F.coalesce("error", F.lit("")))
    listed = results.groupBy("workflow_id").agg(
        F.array_sort(F.collect_set(F.when(failed & known, F.struct(F.col("ord"), text.alias("x"))))).alias("xs"),
        F.bool_or(~known).alias("more"),
    )
    return listed.select(
        "workflow_id",
        F.when(F.col("more"), F.lit("invalid")).when(F.size("xs") > 0, F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.when(F.col("more"), F.lit("too_many_goals")).otherwise(F.array_join(F.col("xs.x"), "; ")).alias("message"),
    )


SECTIONS = ("candidates", "drafts", "exports", "tasks", "workflows")


def workspace_snapshot(projects: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """One row per child of a project (section, seq, body), in the same shape for every size.

    ``sections``: name (of ``SECTIONS``) -> DataFrame(project_id, seq, body).  A project without children has one row
    whose section is null.  ``n_<section>`` is the total of the whole project; totals are partial aggregates, so
    no task sees all children of a project.
    """
    children = None
    for name, df in sections.items():
        part = df.select("project_id", F.lit(name).alias("section"), F.col("seq").cast("long").alias("seq"), "body")
        children = part if children is None else children.unionByName(part)
    totals = children.groupBy("project_id").agg(
        *[F.count_if(F.col("section") == name).alias(f"n_{name}") for name in sections]
    )
    return (
        projects.join(totals, "project_id", "left")
        .join(children, "project_id", "left")
        .withColumns({f"n_{s}": F.coalesce(F.col(f"n_{s}"), F.lit(0).cast("long")) for s in sections})
    )
