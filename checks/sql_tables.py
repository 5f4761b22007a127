"""The model tables again, as SQL over the benchmark tables for another engine."""

from __future__ import annotations

import re

TABLES: dict[str, str] = {
    "ev": """
        SELECT event_id, ts, CAST(user_id AS INTEGER) AS user_id, event_type,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
        FROM events""",
    "ord": """
        SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
               CAST(floor(o_totalprice / 1000) AS INTEGER) AS price_k, o_orderdate, o_orderpriority
        FROM orders""",
    "robot_master": """
        SELECT CAST(c_custkey AS INTEGER) AS id,
               CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'AMR_'
                    WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'AMB_' ELSE 'CART_' END
                 || CAST(c_custkey AS VARCHAR) AS name,
               CASE WHEN c_acctbal < 0 THEN 'n' ELSE ' y ' END AS is_active,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ' undefined '
                    ELSE 'SN-' || CAST(c_custkey AS VARCHAR) END AS serial_number,
               c_mktsegment AS status, NULLIF(c_nationkey, 0) AS factory_id,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c_nationkey AS BIGINT)) AS updated_at
        FROM customer""",
    "robot_dim": """
        SELECT name AS robot_code, CAST(id AS VARCHAR) AS robot_id, is_active = ' y ' AS is_enabled
        FROM robot_master WHERE id IN (SELECT user_id FROM ev)""",
    "scope": """
        SELECT id AS master_robot_id, name AS robot_code,
               CASE WHEN upper(trim(name)) LIKE 'AMR%' THEN 'AMR' WHEN upper(trim(name)) LIKE 'AMB%' THEN 'AMB'
                    ELSE 'OTHER' END AS robot_type
        FROM robot_master WHERE upper(trim(coalesce(is_active, ''))) = 'Y'""",
    "bridge": """
        SELECT master_robot_id, robot_code, robot_type, robot_code AS robot_reference FROM scope
        UNION SELECT master_robot_id, robot_code, robot_type, CAST(master_robot_id AS VARCHAR) FROM scope""",
    "project": "SELECT r_regionkey AS id, r_name AS name FROM region",
    "task_dim": """
        SELECT n_nationkey AS job_id, CASE WHEN n_regionkey = 3 THEN '' ELSE n_name END AS task_name FROM nation""",
    "subjob": """
        SELECT n_nationkey AS id, n_name || CASE WHEN n_regionkey = 1 THEN ' Unload' ELSE '' END AS name,
               n_regionkey AS type_id FROM nation""",
    "duration_limit": """
        SELECT p_partkey AS id, CAST(p_size % 25 AS INTEGER) AS job_id,
               NULLIF(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 8, 0) AS subjob_id,
               CASE WHEN p_size = 10 THEN 0 ELSE CAST(floor(p_retailprice) AS BIGINT) END * 86400000 AS limit_ms
        FROM part""",
    "wifi_history": """
        SELECT event_id AS ods_row_id, user_id AS amr_id, ts AS pc_timestamp,
               CASE WHEN event_type = 'error' THEN 0 ELSE -(40 + k % 45) END AS wifi_signal_level FROM ev""",
    "job_history": """
        SELECT event_id AS ods_row_id, user_id AS amr_id, ts AS pc_timestamp,
               CASE WHEN event_type IN ('click', 'view', 'error') THEN 'Running' ELSE 'Idle' END AS job_status,
               CASE WHEN k >= 95 THEN '  ' ELSE ' LM' || CAST(k // 10 AS VARCHAR) || ' ' END AS poi_target FROM ev
        UNION ALL
        SELECT event_id + 1000000000000, user_id, ts, 'Running', CASE WHEN k >= 80 THEN '' ELSE 'LM10' END
        FROM ev WHERE event_type = 'error'""",
    "battery_history": "SELECT user_id AS amr_id, ts AS pc_timestamp, k AS batt_level FROM ev",
    "battery_fact": """
        SELECT m.name AS robot_code, ts AS sample_time,
               CASE event_type WHEN 'purchase' THEN ' charging ' WHEN 'signup' THEN ' ' ELSE 'discharging' END
                 AS charging_status
        FROM ev JOIN robot_master m ON m.id = user_id""",
    "operation_event": """
        SELECT 'ODS' AS source_schema, p.source_table, p.event_id AS source_ods_row_id, p.part AS source_event_part,
               p.at AS event_time, CASE p.source_table WHEN 'AMR_Queue' THEN 'QUEUE' ELSE 'TASK' END AS event_category,
               p.type AS event_type, p.status AS event_status, m.name AS robot_code,
               CASE WHEN k < 90 THEN CAST(user_id AS VARCHAR) END AS robot_id,
               CAST(p.event_id AS VARCHAR) AS queue_id, p.at + INTERVAL 5 MINUTE AS dwd_load_time
        FROM (
            SELECT event_id, user_id, k, 'TA_AMR' AS source_table, 'START' AS part, ts AS at,
                   CASE event_type WHEN 'click' THEN 'JOB_STARTED' ELSE 'SUBJOB_STARTED' END AS type,
                   CAST(NULL AS VARCHAR) AS status
            FROM ev WHERE event_type IN ('click', 'view', 'error')
            UNION ALL
            SELECT event_id, user_id, k, 'TA_AMR', 'END', ts + to_minutes(CAST(k * 10 AS BIGINT)), 'JOB_ENDED',
                   CASE event_type WHEN 'click' THEN ' Success ' ELSE 'failed' END
            FROM ev WHERE event_type IN ('click', 'view')
            UNION ALL
            SELECT event_id, user_id, k, 'AMR_Queue', 'ENQUEUE', ts, 'QUEUE_ENQUEUED', NULL
            FROM ev WHERE event_type = 'signup'
        ) p JOIN robot_master m ON m.id = p.user_id""",
    "event_queue": """
        SELECT CAST(event_id AS VARCHAR) AS queue_id, ts - to_minutes(CAST(k * 3 AS BIGINT)) AS queue_start_time
        FROM ev WHERE event_type = 'click'""",
    "queue_fact": """
        SELECT o_orderkey AS queue_fact_id, CAST(o_orderkey AS VARCHAR) AS queue_id,
               o_orderdate + to_seconds(o_orderkey % 86400) AS event_time,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) ELSE m.name END AS robot_code,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS robot_id,
               CASE WHEN o_orderstatus = 'O' THEN 'in_progress'
                    WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'COMPLEATED'
                    WHEN o_orderstatus = 'F' THEN 'completed'
                    WHEN o_orderpriority = '1-URGENT' THEN ' Aborted ' WHEN o_orderpriority = '2-HIGH' THEN 'cancelled'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'ERROR' ELSE 'failed' END AS queue_status,
               substr(o_orderpriority, 1, 1) AS project_id, CAST(price_k // 20 AS VARCHAR) AS job_id,
               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN price_k // 50 END AS calling_box_id,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL WHEN price_k // 50 >= 8 THEN ''
                    ELSE 'Box ' || CAST(price_k // 50 AS VARCHAR) END AS calling_box_name,
               CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 600 END AS duration_seconds
        FROM ord JOIN robot_master m ON m.id = o_custkey""",
    "order_lines": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate, ord.*
        FROM lineitem JOIN ord ON l_orderkey = o_orderkey""",
    "queue_attempts": """
        SELECT CAST(l_orderkey AS VARCHAR) AS queue_id, o_orderdate + to_seconds(l_partkey) AS event_time,
               CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'Done' WHEN l_returnflag = 'N' THEN 'pending'
                    WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN ' aborted'
                    WHEN l_returnflag = 'R' THEN 'canceled' WHEN l_linestatus = 'F' THEN 'ERROR' ELSE 'Failed' END
                 AS queue_status,
               CAST(o_custkey AS VARCHAR) AS robot_id,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) ELSE m.name END AS robot_code
        FROM order_lines JOIN robot_master m ON m.id = o_custkey""",
    "task_run": """
        SELECT l_orderkey * 8 + l_linenumber AS id, o_custkey AS amr_id, l_orderkey AS queue_id,
               price_k // 20 AS job_id,
               CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL ELSE l_linenumber END AS subjob_id,
               o_orderdate + to_seconds(l_partkey) AS start_time,
               CASE WHEN l_returnflag <> 'R' THEN l_shipdate + to_seconds(l_suppkey) END AS end_time,
               CASE WHEN l_linestatus = 'F' THEN 'success' ELSE 'failed' END AS status
        FROM order_lines""",
    "queue_source": """
        SELECT o_orderkey AS id,
               o_orderdate + to_seconds(CASE WHEN o_orderstatus = 'P' THEN 1000 ELSE -400 END) AS enqueued_at
        FROM ord""",
    "watermark": """
        SELECT 'ODS' AS source_schema, 'AMR_Queue' AS source_table, max(o_orderkey) AS last_ods_row_id FROM ord
        UNION ALL SELECT 'ODS', 'TA_AMR', max(CASE WHEN status = 'success' THEN id END) - 1 FROM task_run
        UNION ALL SELECT 'ODS', 'MA_AMR_Project_Assignment', max(id) FROM robot_master""",
    "hours": """
        SELECT user_id, date_trunc('hour', ts) AS stat_hour, min(event_id) AS row_id, count(*) AS n,
               count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view,
               count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'signup') AS n_signup,
               count(*) FILTER (event_type = 'purchase') AS n_purchase,
               CAST(coalesce(sum(k) FILTER (event_type = 'click'), 0) AS BIGINT) AS k_click,
               CAST(coalesce(sum(k) FILTER (event_type = 'view'), 0) AS BIGINT) AS k_view,
               CAST(coalesce(sum(k) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS k_purchase,
               CAST(sum(k) AS BIGINT) AS k_sum, min(k) AS k_min, max(k) AS k_max,
               CAST(sum(-(40 + k % 45)) FILTER (event_type <> 'error') AS BIGINT) AS level_sum,
               count(*) FILTER (event_type <> 'error') AS level_n,
               min(-(40 + k % 45)) FILTER (event_type <> 'error') AS level_min,
               max(-(40 + k % 45)) FILTER (event_type <> 'error') AS level_max,
               count(*) FILTER (event_type <> 'error' AND -(40 + k % 45) <= -67) AS level_weak,
               min(ts) AS first_ts, max(ts) AS last_ts, max(ts) + to_minutes(CAST(max(k) * 20 AS BIGINT)) AS load_time
        FROM ev GROUP BY 1, 2""",
    "status_hourly": """
        SELECT row_id AS status_hourly_id, CAST(user_id AS VARCHAR) AS robot_code, stat_hour, n AS sample_count,
               n - n_error AS online_sample_count, n_error AS error_sample_count, k_sum * 1000 // n AS speed_milli,
               k_max AS max_speed, first_ts AS first_status_time, last_ts AS last_status_time,
               load_time AS dws_load_time FROM hours""",
    "battery_hourly": """
        SELECT row_id AS battery_hourly_id, m.name AS robot_code, stat_hour, n AS sample_count,
               k_sum * 100 // n AS soc_centi, k_min, k_max, n_purchase AS charging_sample_count,
               first_ts AS first_sample_time, last_ts AS last_sample_time, load_time AS dws_load_time
        FROM hours JOIN robot_master m ON m.id = user_id""",
    "wifi_hourly": """
        SELECT row_id AS wifi_hourly_id, CAST(user_id AS VARCHAR) AS robot_code, stat_hour, n AS sample_count,
               CASE WHEN level_n > 0 THEN -(abs(level_sum) * 100 // level_n) END AS rssi_centi, level_min, level_max,
               level_weak AS weak_signal_sample_count, last_ts AS last_sample_time, load_time AS dws_load_time
        FROM hours""",
    "job_daily": """
        SELECT CAST(user_id AS VARCHAR) AS robot_code, CAST(ts AS DATE) AS stat_date, event_type AS job_type_code,
               CASE WHEN event_type = 'view' THEN ' ' ELSE 'AUTO' END AS robot_mode_id,
               CASE WHEN event_type = 'click' THEN NULL ELSE 'Automatic' END AS robot_mode_detail,
               count(*) AS job_count, count(DISTINCT k) AS distinct_job_count,
               count(*) FILTER (event_type IN ('click', 'view', 'purchase')) AS completed_status_count,
               count(*) FILTER (event_type = 'error') AS failed_status_count, min(ts) AS first_job_start_time,
               max(ts) AS last_job_start_time, min(event_id) AS job_daily_id,
               max(ts) + INTERVAL 30 MINUTE AS dws_load_time
        FROM ev GROUP BY user_id, CAST(ts AS DATE), event_type
        UNION ALL
        SELECT CAST(user_id AS VARCHAR), CAST(ts AS DATE), '__ALL__', '__ALL__', NULL, count(*), count(DISTINCT k),
               count(*) FILTER (event_type IN ('click', 'view', 'purchase')),
               count(*) FILTER (event_type = 'error'), min(ts), max(ts), min(event_id), max(ts) + INTERVAL 30 MINUTE
        FROM ev GROUP BY user_id, CAST(ts AS DATE)""",
    "queue_daily": """
        SELECT robot_code, CAST(event_time AS DATE) AS stat_date, count(*) AS queue_count,
               count(DISTINCT queue_id) AS distinct_queue_count,
               count(*) FILTER (queue_status IN ('completed', 'COMPLEATED')) AS completed_status_count,
               count(*) FILTER (queue_status IN ('failed', 'ERROR')) AS failed_status_count,
               max(duration_seconds) AS avg_duration_seconds
        FROM queue_fact GROUP BY 1, 2""",
    "task_hourly": """
        SELECT *, 3600 - executing_seconds - charging_seconds - waiting_seconds - no_task_seconds
                    AS data_unavailable_seconds
        FROM (
            SELECT stat_hour, m.name AS robot_code, CAST(user_id AS VARCHAR) AS robot_id,
                   least(k_click * 10, 1200) AS executing_seconds, least(k_purchase * 9, 900) AS charging_seconds,
                   least(k_view * 8, 600) AS waiting_seconds,
                   CAST(CASE WHEN n_signup > 0 THEN 900 ELSE 0 END AS BIGINT) AS no_task_seconds,
                   n_signup AS accepted_queue_count, n_click AS task_started_count, n_view AS subtask_started_count,
                   n_purchase AS task_completed_count, first_ts AS first_source_event_time,
                   last_ts AS last_source_event_time, load_time AS dws_load_time
            FROM hours JOIN robot_master m ON m.id = user_id)""",
    "calling_box_hourly": """
        SELECT date_trunc('hour', ts) AS stat_hour, m.name AS robot_code,
               'Box ' || CAST(k // 10 AS VARCHAR) AS calling_box_label, count(*) AS calling_box_count,
               min(ts) AS first_called_at, max(ts) AS last_called_at
        FROM ev JOIN robot_master m ON m.id = user_id GROUP BY 1, 2, 3""",
    "assigned_task_hourly": """
        SELECT date_trunc('hour', ts) AS stat_hour, m.name AS robot_code,
               'Task ' || CAST(k // 5 AS VARCHAR) AS task_label, count(*) AS assigned_task_count,
               count(*) FILTER (event_type IN ('click', 'purchase')) AS completed_task_count,
               min(ts) AS first_assigned_at, max(ts) AS last_assigned_at
        FROM ev JOIN robot_master m ON m.id = user_id GROUP BY 1, 2, 3""",
}


def with_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """Put the model tables ``sql`` mentions in front of it as a WITH clause.

    ``extra`` are further CTEs private to the query, in order.
    """
    extra = extra or {}
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_]+", text)):
            if word in TABLES and word not in needed and word not in extra:
                visit(TABLES[word])
                if word not in needed:
                    needed.append(word)

    for body in [*extra.values(), sql]:
        visit(body)
    parts = [f"{name} AS ({TABLES[name]})" for name in needed] + [f"{name} AS ({body})" for name, body in extra.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
