"""The jobs as registered queries: each run twice into one new folder, and their SQL."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.functions import binning
from basinflow.plans import sqltext as S
from basinflow.session import work_dir

from . import landscape, transitions


def _config(name: str) -> dict[str, Any]:
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), encoding="utf-8") as f:
        return json.load(f)


def job1_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition matrices of all events; the second run finds nothing new."""
    config, folder = _config("transitions"), f"{work_dir(spark)}/job1-{uuid.uuid4().hex}"
    # a pattern: a stream reads a folder or the files that match one, and the table may be a single file
    source = f"{sf_dir}/[e]vents.parquet"
    for _ in range(2):
        transitions.run(spark, source, f"{folder}/out", f"{folder}/marks", config)
    out = transitions.read_matrix(spark, f"{folder}/out", spark.read.parquet(source).schema, config)
    return out.withColumns({"probability": F.round("probability", 6), "rate": F.round("rate", 6)})


def job2_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landscape of all turns of conversations, by role."""
    config, folder = _config("landscape"), f"{work_dir(spark)}/job2-{uuid.uuid4().hex}"
    source = f"{sf_dir}/conversations.parquet"
    for _ in range(2):
        landscape.run(spark, source, f"{folder}/out", f"{folder}/work", config)
    out = landscape.read_landscape(spark, source, f"{folder}/out", config)
    return out.withColumn("free_energy", F.round("free_energy", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to ``(spark, sf_dir) -> DataFrame``."""
    return {f.__name__: f for f in (job1_transitions, job2_landscape)}


def _transitions_sql() -> str:
    state = "CASE WHEN event_type = 'error' THEN 'noise' WHEN event_type = 'view' AND user_id % 7 = 0 THEN NULL ELSE event_type END"
    return f"""WITH f AS (SELECT user_id // 5 AS trajectory_id, user_id % 5 AS bead_id, event_id, {state} AS s FROM events),
w AS (SELECT *, lead(s, 2) OVER (PARTITION BY trajectory_id, bead_id ORDER BY event_id) AS d FROM f WHERE s <> 'noise'),
c AS (SELECT trajectory_id, bead_id, s AS src, d AS dst, count(*) AS count FROM w WHERE d IS NOT NULL GROUP BY ALL),
l AS (SELECT DISTINCT trajectory_id, bead_id, unnest([src, dst]) AS label FROM c),
m AS (SELECT a.trajectory_id, a.bead_id, a.label AS src, b.label AS dst, coalesce(c.count, 0)::BIGINT AS count FROM l a JOIN l b USING (trajectory_id, bead_id)
  LEFT JOIN c ON c.trajectory_id = a.trajectory_id AND c.bead_id = a.bead_id AND c.src = a.label AND c.dst = b.label),
p AS (SELECT *, count / nullif(sum(count) OVER (PARTITION BY trajectory_id, bead_id, src), 0)::DOUBLE AS probability FROM m)
SELECT trajectory_id, bead_id, src, dst, count, round(probability, 6) AS probability, round(probability / (2 * 0.5::DOUBLE), 6) AS rate FROM p"""


def _landscape_sql() -> str:
    config = _config("landscape")
    x_edges, y_edges = binning.stepped_edges(*config["x_domain"], config["x_step"]), binning.stepped_edges(*config["y_domain"], config["y_step"])
    nx, ny = len(x_edges) - 1, len(y_edges) - 1
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    letters = r"length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))"
    dx, dy = f"(x - {S.bin_centre('xi', x_edges)})", f"(y - {S.bin_centre('yi', y_edges)})"
    return f"""WITH RECURSIVE f AS (SELECT role, conv_id, turn, {words}::DOUBLE AS x, {letters} / nullif({words}, 0)::DOUBLE AS y FROM conversations),
b AS (SELECT *, {S.bin_index('x', x_edges)} AS xi, {S.bin_index('y', y_edges)} AS yi FROM f),
d AS (SELECT *, {dx} * {dx} + {dy} * {dy} AS d FROM b WHERE xi >= 0 AND yi >= 0),
n AS (SELECT *, row_number() OVER (PARTITION BY role, xi, yi ORDER BY d, conv_id, turn) AS nth, count(*) OVER (PARTITION BY role, xi, yi) AS count FROM d),
t AS (SELECT * FROM n WHERE nth = 1),
occupied AS (SELECT role, xi, yi FROM t WHERE count >= {config['min_count']}), {S.components('occupied', nx, ny, False, ('role',))}
SELECT t.role, t.xi::INT AS xi, t.yi::INT AS yi, count, conv_id, turn, x, y, round(ln(max(count) OVER (PARTITION BY t.role) / count), 6) AS free_energy, coalesce(component::VARCHAR, 'noise') AS state
FROM t LEFT JOIN numbered m ON m.role = t.role AND m.xi = t.xi AND m.yi = t.yi"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of what the jobs leave."""
    return {"job1_transitions": _transitions_sql(), "job2_landscape": _landscape_sql()}
