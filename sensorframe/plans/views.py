"""Sensor-evidence tables derived from general-purpose warehouse tables.

Each view is one SQL text valid in Spark and in other ANSI engines, so a result
can be checked elsewhere on exactly the same input.  ``events`` becomes frames,
detections, predictions, ground truth, anomaly observations and sensor events;
``embeddings`` becomes track observations with vectors; ``orders`` and
``lineitem`` become images and annotations; ``documents`` becomes file listings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

# Sixteen consecutive events are the slots of one time step: four runs with
# four lanes each.  A lane is a place in the picture where one object stands.
VIEWS["v_slots"] = """
SELECT event_id, user_id, event_type, value, ts,
       CAST(floor(event_id / 16) AS BIGINT) AS frame_ordinal,
       concat('run_', CAST(CAST(floor((event_id % 16) / 4) AS BIGINT) AS STRING)) AS run_id,
       event_id % 4 AS lane
FROM events
"""

VIEWS["v_frames"] = """
SELECT DISTINCT run_id, frame_ordinal, frame_ordinal * 2 AS frame_number,
       CAST(frame_ordinal AS DOUBLE) / 10 AS timestamp_s,
       concat(run_id, '_', CAST(frame_ordinal AS STRING)) AS frame_id,
       concat('/frames/', run_id, '/', CAST(frame_ordinal AS STRING), '.jpg') AS image_path,
       CAST(CASE WHEN frame_ordinal % 50 = 7 THEN 300 ELSE 640 END AS INT) AS width,
       CAST(CASE WHEN frame_ordinal % 50 = 7 THEN 401 ELSE 480 END AS INT) AS height,
       concat('CAM_', run_id) AS sensor_id,
       CASE WHEN run_id IN ('run_0', 'run_2') THEN 'EO' ELSE 'IR' END AS modality,
       concat('/video/', run_id, '.mp4') AS source_path
FROM v_slots
"""

VIEWS["v_detections"] = """
SELECT run_id, frame_ordinal, frame_ordinal * 2 AS frame_number,
       CAST(frame_ordinal AS DOUBLE) / 10 AS timestamp_s,
       lane AS detection_index,
       CASE WHEN lane <= 1 THEN 'person' WHEN lane = 2 THEN 'car' ELSE 'truck' END AS label,
       user_id AS object_id,
       CASE WHEN event_type = 'signup' THEN 'normal_maintenance'
            WHEN event_type = 'purchase' THEN 'intrusion_vehicle' END AS scenario_role,
       value / 500 AS confidence,
       CAST(lane * 100 + user_id % 11 AS INT) AS x1, CAST(50 AS INT) AS y1,
       CAST(lane * 100 + user_id % 11 + 20 AS INT) AS x2, CAST(70 AS INT) AS y2
FROM v_slots
WHERE event_type <> 'error'
"""

# Every event is one annotated object and one prediction near it; neighbours overlap.
VIEWS["v_ground_truth"] = """
SELECT run_id, frame_ordinal AS frame_index, event_id AS target_id, event_id AS ground_truth_index,
       CASE WHEN user_id % 19 = 0 THEN 'van' WHEN lane = 3 THEN 'motor'
            WHEN user_id % 2 = 0 THEN 'pedestrian' ELSE 'people' END AS label,
       user_id % 17 = 0 AS ignored,
       CAST(lane * 12 AS INT) AS x1, CAST(0 AS INT) AS y1,
       CAST(lane * 12 + 20 AS INT) AS x2, CAST(20 AS INT) AS y2
FROM v_slots
"""

VIEWS["v_predictions"] = """
SELECT run_id, frame_ordinal AS frame_number, event_id AS prediction_index,
       CASE WHEN user_id % 13 = 0 THEN 'sports ball' WHEN user_id % 7 = 0 THEN 'car'
            WHEN lane = 3 THEN 'motorcycle' ELSE 'person' END AS label,
       floor(value / 5) / 100 AS confidence,
       CAST(lane * 12 + user_id % 11 AS INT) AS x1, CAST(0 AS INT) AS y1,
       CAST(lane * 12 + user_id % 11 + 20 AS INT) AS x2, CAST(20 AS INT) AS y2
FROM v_slots
WHERE event_type <> 'error'
"""

VIEWS["v_anomalies"] = """
SELECT run_id, frame_ordinal, frame_ordinal * 2 AS frame_number,
       CAST(frame_ordinal AS DOUBLE) / 10 AS timestamp_s, lane AS track_id, 'person' AS label,
       value / 100 AS score, CAST(0.4 AS DOUBLE) AS threshold, value / 100 - CAST(0.4 AS DOUBLE) AS margin,
       value / 100 > CAST(0.4 AS DOUBLE) AS is_anomaly, 'centroid' AS source
FROM v_slots
WHERE event_type <> 'error'
"""

VIEWS["v_manifests"] = """
SELECT DISTINCT concat('sensor_run_', CAST(user_id % 3 AS STRING)) AS run_id,
       concat('SENSOR_', CAST(user_id % 3 AS STRING)) AS sensor_id,
       CASE user_id % 3 WHEN 0 THEN 'EO' WHEN 1 THEN 'IR' ELSE 'OTHER' END AS modality,
       concat('/runs/', CAST(user_id % 3 AS STRING)) AS run_dir,
       'completed' AS status, 'processed_frames' AS ground_truth_scope,
       concat('2024-01-0', CAST(user_id % 3 + 1 AS STRING)) AS created_at, 'folder' AS input_source
FROM events
"""

VIEWS["v_sensor_events"] = """
SELECT concat('sensor_run_', CAST(user_id % 3 AS STRING)) AS run_id,
       concat('e', CAST(event_id AS STRING)) AS event_id, event_id AS frame_number, CAST({micros} AS DOUBLE) / 1000000 AS timestamp_s,
       event_type, CASE WHEN value > 100 THEN 'critical' WHEN value > 20 THEN 'warning' ELSE 'info' END AS severity,
       'test' AS source, user_id AS track_id,
       CASE user_id % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'car' WHEN 2 THEN 'truck' WHEN 3 THEN 'bus' END AS label,
       value / 500 AS confidence
FROM events
"""

VIEWS["v_evidence"] = """
SELECT *, replace(run_id, 'sensor_run_', 'SENSOR_') AS sensor_id,
       CASE run_id WHEN 'sensor_run_0' THEN 'EO' WHEN 'sensor_run_1' THEN 'IR' ELSE 'OTHER' END AS modality,
       replace(run_id, 'sensor_run_', '/runs/') AS run_dir
FROM v_sensor_events
"""

VIEWS["v_reps"] = """
SELECT concat('run_', CAST(vec_id % 2 AS STRING)) AS run_id, vec_id,
       CAST(floor(vec_id / 16) AS BIGINT) AS frame_ordinal, CAST(floor(vec_id / 16) AS BIGINT) * 2 AS frame_number,
       CAST(floor(vec_id / 16) AS DOUBLE) / 10 AS timestamp_s,
       CAST(floor((vec_id % 16) / 2) AS BIGINT) + 1 AS track_id,
       CAST(floor(vec_id / 16) AS BIGINT) + 1 AS hits,
       concat('class_', CAST(label AS STRING)) AS label,
       CAST(vec_id * 7 % 11 AS DOUBLE) / 10 AS confidence,
       CAST(400 AS INT) AS width, CAST(60 AS INT) AS height,
       CAST(vec_id % 16 * 20 AS INT) AS x1, CAST(45 + vec_id % 10 AS INT) AS y1,
       CAST(vec_id % 16 * 20 + 10 AS INT) AS x2, CAST(55 + vec_id % 10 AS INT) AS y2,
       embedding
FROM embeddings
"""

VIEWS["v_images"] = """
SELECT o_orderkey AS id, concat('img', CAST(o_orderkey AS STRING), '.jpg') AS file_name,
       CAST(640 AS INT) AS width, CAST(480 AS INT) AS height
FROM orders
"""

VIEWS["v_annotations"] = """
SELECT l_orderkey AS image_id,
       CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS category_id,
       l_partkey AS id, l_quantity AS area
FROM lineitem
"""

VIEWS["v_categories"] = """
SELECT DISTINCT CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS id,
       CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'N' THEN 'car' ELSE 'dog' END AS name
FROM lineitem
"""

VIEWS["v_native"] = """
SELECT concat('seq', CAST(l_suppkey % 10 AS STRING)) AS run_id, l_orderkey AS frame_index, l_partkey AS target_id,
       l_quantity AS bbox_left, l_discount * 100 AS bbox_top, l_quantity / 3 AS bbox_width, l_tax * 100 + 1 AS bbox_height,
       CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS score,
       CAST(l_linenumber * 2 % 13 AS INT) AS object_category,
       CAST(l_linenumber % 2 AS INT) AS truncation, CAST(l_linenumber % 3 AS INT) AS occlusion
FROM lineitem
"""

# Names whose digit runs have no padding, so text order and natural order differ.
VIEWS["v_paths"] = """
SELECT concat('/data/', event_type, '/', CASE WHEN value > 50 THEN 'Img' ELSE 'img' END,
              CAST(user_id AS STRING), '_', CAST(event_id AS STRING), '.jpg') AS path
FROM events
"""

VIEWS["v_files"] = """
SELECT source AS run_id, concat('/runs/', source, '/', CAST(doc_id AS STRING), '.', lang) AS path,
       lang AS category, n_chars AS length, text
FROM documents
"""

_MICROS = {"spark": "unix_micros(CAST(ts AS TIMESTAMP))", "duckdb": "epoch_us(ts)"}


def _needs(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or derived view below ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("{micros}", _MICROS["spark"])
    inputs = _needs(sql, [n for n in (*TABLES, *VIEWS) if n != name])
    for n in inputs:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    used = [n for n in inputs if f"{{{n}}}" in sql]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in used})


def with_views(sql: str) -> str:
    """``sql`` as one ANSI statement with the derived views it uses as CTEs."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in _needs(text, VIEWS):
            if n not in order:
                add(VIEWS[n])
                if n not in order:
                    order.append(n)

    add(sql)
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in order]
    body = sql.strip()
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = " RECURSIVE", body[len("WITH RECURSIVE"):].strip()
        ctes_text = ", ".join(ctes + [body]) if ctes else body
        return f"WITH{recursive} {ctes_text}".replace("{micros}", _MICROS["duckdb"])
    if body.upper().startswith("WITH "):
        body = body[5:].strip()
        return f"WITH {', '.join(ctes + [body])}".replace("{micros}", _MICROS["duckdb"])
    prefix = f"WITH {', '.join(ctes)} " if ctes else ""
    return (prefix + body).replace("{micros}", _MICROS["duckdb"])
