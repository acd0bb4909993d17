"""The weekly citation run as one job: due prompts to appended checks and usage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mentions as M
from ..operators import quotas as Q
from ..operators import sinks
from ..sources.answers import scan_answers
from ..sources.versions import read_version


def due_tasks(prompts: DataFrame, workspaces: DataFrame, as_of: datetime, stale_hours: int = Q.STALE_HOURS) -> DataFrame:
    """Due prompts of eligible workspaces, with the engines their plan covers."""
    eligible = Q.eligible_workspaces(workspaces).select("workspace_id", "engines_limit")
    due = Q.stale_prompts(prompts.join(eligible, "workspace_id"), as_of, stale_hours)
    return M.engines_allowed(due)


def weekly_checks(
    prompts: DataFrame, workspaces: DataFrame, sites: DataFrame, competitors: DataFrame, recorded: DataFrame,
    as_of: datetime, stale_hours: int = Q.STALE_HOURS,
) -> DataFrame:
    """One check row per due prompt and engine.

    ``recorded`` holds the payloads of this run (``prompt_id, engine, http_status, payload``). A task
    without a payload becomes an errored row; no failure stops the others.
    """
    tasks = due_tasks(prompts, workspaces, as_of, stale_hours).select(
        "prompt_id", "workspace_id", "site_id", "allowed_engines"
    )
    answers = scan_answers(recorded).select("prompt_id", "engine", "answer", "urls", "error", "excerpt_override")
    rows = M.fanout_engines(tasks, answers).drop("allowed_engines")
    analysed = M.analyse_response(rows, M.build_dictionary(sites, competitors))
    return analysed.drop("answer", "first_index").withColumns(
        {
            "check_id": F.sha2(F.concat_ws("|", "prompt_id", "engine", F.lit(as_of.isoformat())), 256),
            "mode": F.lit("live"),
            "trigger_source": F.lit("schedule"),
            "checked_at": F.lit(as_of),
        }
    )


def run_weekly(
    prompts: DataFrame, workspaces: DataFrame, sites: DataFrame, competitors: DataFrame, recorded: DataFrame,
    as_of: datetime, history_path: str, prompts_path: str | None = None,
) -> DataFrame:
    """Append this run's checks and return its usage increments.

    With ``prompts_path`` the prompts are stored there with their new ``last_checked_at``, so the next run
    does not find them due again. A run repeated at the same ``as_of`` adds nothing. Both are versioned tables, read with ``read_version``.
    """
    sinks.append_checks(weekly_checks(prompts, workspaces, sites, competitors, recorded, as_of), history_path)
    written = read_version(prompts.sparkSession, history_path).filter(
        (F.col("day") == as_of.strftime("%Y-%m-%d")) & (F.col("checked_at") == F.lit(as_of))
    )
    if prompts_path is not None:
        sinks.replace_rows(Q.prompts_touched(prompts, written.select("prompt_id", "checked_at")), prompts_path)
    return written.groupBy("workspace_id").agg(F.count("*").alias("count")).select(
        "workspace_id", F.lit(as_of.strftime("%Y-%m")).alias("period"), F.lit("citation_checks").alias("metric"), "count"
    )

