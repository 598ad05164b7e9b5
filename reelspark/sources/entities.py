"""JSON-document tables: typed scans, keyed upserts and insert-if-absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCENE = "struct<id:string,label:string,start:double,end:double,evidence:string>"
ENTITY_SCHEMAS = {
    "project": "id string, name string, url string, status string, duration double, width int, height int,"
    " created_at timestamp, updated_at timestamp, error string, has_audio boolean, subtitle_status string,"
    " subtitle_source string",
    "task": "id string, project_id string, kind string, status string, stage string, progress double,"
    " completed_steps array<string>, heartbeat timestamp, created_at timestamp, updated_at timestamp,"
    " error string, retryable boolean, cancel_requested boolean, payload string, workflow_id string,"
    " goal string, lease_id string",
    "draft": f"id string, project_id string, title string, hook string, scenes array<{SCENE}>, aspect string,"
    " layout string, crop_x double, title_style string, title_template_version int, title_motion boolean,"
    " title_enabled boolean, title_scale double, title_y double, title_accent string, subtitles boolean,"
    " original_audio boolean, revision int, updated_at timestamp, origin string, parent_draft_id string,"
    " parent_revision int, goal string",
    "export": "task_id string, draft_id string, revision int, title string, created_at timestamp",
    "workflow": "id string, project_id string, plan_revision int, auto_export boolean, status string,"
    " goals array<struct<goal:string,status:string,error:string,draft_ids:array<string>,"
    "export_task_ids:array<string>>>, created_at timestamp, updated_at timestamp",
}


def read_entities(
    raw: DataFrame, entity: str, body_col: str = "body", seq_col: str = "seq", newest_first: bool = False
) -> DataFrame:
    """Typed columns of one entity, its insertion sequence, and ``reason`` where a body is missing or does not parse.

    ``newest_first`` adds a global sort; leave it off when the result feeds another operator.
    """
    schema = f"{ENTITY_SCHEMAS[entity]}, __bad string"
    body = F.from_json(body_col, schema, {"columnNameOfCorruptRecord": "__bad"})
    reason = F.when(F.col(body_col).isNull(), F.lit("no_body")).when(F.col("e.__bad").isNotNull(), F.lit("malformed_json"))
    typed = (
        raw.withColumn("e", body)
        .withColumn("reason", reason)
        .withColumn("e", F.when(F.col("reason").isNull(), F.col("e")))  # no half-read rows
        .select(seq_col, "e.*", "reason")
        .drop("__bad")
    )
    return typed.orderBy(F.col(seq_col).desc()) if newest_first else typed


def upsert(
    base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[str] = (), mode: str = "replace"
) -> DataFrame:
    """Batch table maintenance.

    ``replace``: the newest delta row (by ``order``) of a key replaces the stored one.  ``ignore``: the
    stored row stays; of several new rows the earliest is inserted.  Only the delta is reduced (a bounded rank, so a key
    with many delta rows is cut in the map tasks); base rows pass one anti join and are never aggregated.
    """
    replace = mode == "replace"
    ranked = [F.col(c).desc() if replace else F.col(c).asc() for c in order or keys]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*ranked))
    new = delta.withColumn("__rank", first).where("__rank = 1").select(*base.columns)
    keep, add = (base.join(new.select(*keys), list(keys), "left_anti"), new) if replace else (
        base, new.join(base.select(*keys), list(keys), "left_anti")
    )
    return keep.select(*base.columns).unionByName(add.select(*base.columns))
