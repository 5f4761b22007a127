"""SQL for another engine that computes the registered queries its own way."""

from __future__ import annotations

from .sql_tables import with_tables

ORACLES: dict[str, str] = {}
BODIES: dict[str, str] = {}


def oracle(name: str, sql: str, **ctes: str) -> None:
    BODIES[name] = sql
    ORACLES[name] = with_tables(sql, ctes)


def ratio(num: str, den: str, scale: int = 2, factor: int = 1) -> str:
    """Exact quotient rounded half away from zero, as a double."""
    unit = 10 ** scale
    return (
        f"CASE WHEN ({den}) > 0 THEN CAST(sign({num}) * ((abs({num}) * {2 * unit * factor} + ({den})) // (2 * ({den}))) "
        f"AS DOUBLE) / {unit} END"
    )


def percent(num: str, den: str, scale: int = 2) -> str:
    return ratio(num, den, scale, 100)


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
TIMEOUT = 1440

# -- scope and fleet -----------------------------------------------------------

oracle("robot_scope", "SELECT * FROM scope")
oracle("robot_scope_amr", "SELECT * FROM scope WHERE robot_type = 'AMR'")
oracle("reference_bridge", "SELECT robot_reference, master_robot_id FROM bridge")
oracle("commissioned_count", """
    SELECT count(*) AS commissioned_robot_count FROM robot_master
    WHERE factory_id IS NOT NULL AND (upper(trim(is_active)) = 'Y'
          OR upper(trim(coalesce(serial_number, ''))) NOT IN ('', 'UNDEFINED', 'NULL'))""")


def latest_sql(table: str, event: str, row_id: str) -> str:
    return f"""
        SELECT * FROM (
            SELECT s.master_robot_id, h.*,
                   row_number() OVER (PARTITION BY s.master_robot_id
                                      ORDER BY h.{event} DESC, h.dws_load_time DESC, h.{row_id} DESC) AS rn
            FROM scope s JOIN {table} h
              ON h.robot_code = s.robot_code OR h.robot_code = CAST(s.master_robot_id AS VARCHAR)) WHERE rn = 1"""


oracle("latest_per_key", "SELECT master_robot_id, status_hourly_id, last_status_time, dws_load_time FROM st",
       st=latest_sql("status_hourly", "last_status_time", "status_hourly_id"))


def gate(event: str, load: str) -> str:
    return f"""CASE WHEN {event} IS NULL OR {load} IS NULL THEN 'MISSING'
        WHEN date_diff('minute', {load}, {AS_OF}) > {TIMEOUT} THEN 'DWS_REFRESH_TIMEOUT'
        WHEN date_diff('minute', {event}, {load}) > {TIMEOUT} THEN 'DWS_SOURCE_LAG'
        WHEN date_diff('minute', {event}, {AS_OF}) > {TIMEOUT} THEN 'SOURCE_TIMEOUT' ELSE 'CURRENT' END"""


FLEET = {
    "lst": latest_sql("status_hourly", "last_status_time", "status_hourly_id"),
    "lba": latest_sql("battery_hourly", "last_sample_time", "battery_hourly_id"),
    "lwi": latest_sql("wifi_hourly", "last_sample_time", "wifi_hourly_id"),
    "ljo": latest_sql("job_daily", "last_job_start_time", "job_daily_id"),
    "gated": f"""
        SELECT s.master_robot_id, s.robot_code, s.robot_type, m.serial_number, m.updated_at,
               {gate('lst.last_status_time', 'lst.dws_load_time')} AS status_freshness_status,
               {gate('lba.last_sample_time', 'lba.dws_load_time')} AS battery_freshness_status,
               {gate('lwi.last_sample_time', 'lwi.dws_load_time')} AS wifi_freshness_status,
               lst.last_status_time AS st_time, lst.dws_load_time AS st_load, lba.last_sample_time AS ba_time,
               lwi.last_sample_time AS wi_time, lwi.dws_load_time AS wi_load,
               lst.speed_milli, lba.soc_centi, lwi.rssi_centi, lwi.level_min, lwi.sample_count AS wi_n,
               lwi.weak_signal_sample_count AS wi_weak, lst.status_hourly_id, lba.battery_hourly_id, lwi.wifi_hourly_id,
               ljo.last_job_start_time AS jo_time,
               greatest(lst.last_status_time, lba.last_sample_time, lwi.last_sample_time, ljo.last_job_start_time)
                 AS source_event_time,
               greatest(lst.dws_load_time, lba.dws_load_time, lwi.dws_load_time) AS load_time
        FROM scope s JOIN robot_master m ON m.id = s.master_robot_id
        LEFT JOIN lst USING (master_robot_id) LEFT JOIN lba USING (master_robot_id)
        LEFT JOIN lwi USING (master_robot_id) LEFT JOIN ljo USING (master_robot_id)""",
    "fleet": """
        SELECT *, CASE WHEN battery_freshness_status = 'CURRENT' THEN soc_centi END AS soc,
               CASE WHEN status_freshness_status = 'CURRENT' THEN 'ONLINE' ELSE 'TIMEOUT' END AS online_status
        FROM gated""",
}

oracle("freshness_gate", f"""
    SELECT master_robot_id, robot_code, robot_type, online_status, status_freshness_status, battery_freshness_status,
           wifi_freshness_status, date_diff('minute', st_time, {AS_OF}) AS status_data_age_minutes,
           date_diff('minute', st_load, {AS_OF}) AS status_refresh_age_minutes,
           date_diff('minute', st_time, st_load) AS status_pipeline_lag_minutes,
           CAST(soc AS DOUBLE) / 100 AS battery_soc,
           CASE WHEN status_freshness_status = 'CURRENT' THEN CAST(speed_milli AS DOUBLE) / 1000 END AS speed_mps,
           source_event_time, load_time AS dws_load_time, status_hourly_id IS NOT NULL AS has_dws_status,
           jo_time AS job_event_time
    FROM fleet""", **FLEET)
oracle("fleet_kpis", f"""
    SELECT count(*) AS total_robot_count,
           (SELECT count(*) FROM robot_master WHERE factory_id IS NOT NULL AND (upper(trim(is_active)) = 'Y'
              OR upper(trim(coalesce(serial_number, ''))) NOT IN ('', 'UNDEFINED', 'NULL')))
             AS commissioned_robot_count,
           count(*) FILTER (status_hourly_id IS NOT NULL OR battery_hourly_id IS NOT NULL OR wifi_hourly_id IS NOT NULL)
             AS dws_known_robot_count,
           count(*) FILTER (status_freshness_status = 'CURRENT') AS current_data_robot_count,
           count(*) FILTER (status_freshness_status NOT IN ('CURRENT', 'MISSING')) AS timed_out_robot_count,
           count(*) FILTER (status_freshness_status = 'MISSING') AS missing_data_robot_count,
           count(*) FILTER (online_status = 'ONLINE') AS online_robot_count,
           count(*) FILTER (online_status = 'TIMEOUT') AS offline_robot_count,
           count(*) FILTER (soc BETWEEN 0 AND 2000) AS low_battery_robot_count,
           {ratio('sum(soc)', 'count(soc) * 100')} AS avg_battery_soc,
           max(source_event_time) AS latest_source_event_time, max(load_time) AS latest_dws_load_time,
           max(updated_at) AS latest_master_update_time,
           date_diff('minute', max(source_event_time), {AS_OF}) AS source_anchor_lag_minutes,
           date_diff('minute', max(load_time), {AS_OF}) AS dws_refresh_lag_minutes,
           {TIMEOUT} AS freshness_timeout_minutes, 'DWS_NON_SNAPSHOT' AS current_data_source
    FROM fleet""", **FLEET)
oracle("freshness_distribution", """
    SELECT CASE status_freshness_status WHEN 'CURRENT' THEN 'DWS Data Current'
                WHEN 'DWS_REFRESH_TIMEOUT' THEN 'DWS Refresh Timeout' WHEN 'DWS_SOURCE_LAG' THEN 'DWS Source Lag'
                WHEN 'SOURCE_TIMEOUT' THEN 'Source Data Timeout' ELSE 'DWS Data Missing' END AS status_name,
           count(*) AS robot_count FROM fleet GROUP BY 1""", **FLEET)
oracle("freshness_donut", """
    SELECT CASE status_freshness_status WHEN 'CURRENT' THEN 'current' WHEN 'MISSING' THEN 'missing' ELSE 'delayed' END
             AS status_name, count(*) AS robot_count FROM fleet GROUP BY 1""", **FLEET)


def in_hours(table: str) -> dict[str, str]:
    refs = "(SELECT robot_reference FROM bridge)"
    return {"inwin": f"""
        SELECT * FROM {table} WHERE robot_code IN {refs}
          AND stat_hour >= (SELECT max(stat_hour) FROM {table} WHERE robot_code IN {refs}) - INTERVAL 719 HOUR"""}


oracle("weighted_hourly_trend", f"""
    SELECT stat_hour, {big('sum(sample_count)')} AS sample_count,
           {ratio('sum(soc_centi * sample_count)', 'sum(sample_count) * 100')} AS avg_battery_soc,
           CAST(min(k_min) AS DOUBLE) AS min_battery_soc, CAST(max(k_max) AS DOUBLE) AS max_battery_soc,
           {big('sum(charging_sample_count)')} AS charging_sample_count
    FROM inwin GROUP BY stat_hour""", **in_hours("battery_hourly"))
oracle("status_hourly_trend", f"""
    SELECT stat_hour, {big('sum(sample_count)')} AS sample_count,
           {ratio('sum(speed_milli * sample_count)', 'sum(sample_count) * 1000', 3)} AS avg_speed_mps,
           CAST(max(max_speed) AS DOUBLE) AS max_speed_mps,
           {big('sum(online_sample_count)')} AS online_sample_count,
           {big('sum(error_sample_count)')} AS error_sample_count
    FROM inwin GROUP BY stat_hour""", **in_hours("status_hourly"))
oracle("wifi_hourly_trend", f"""
    SELECT stat_hour, {big('sum(sample_count)')} AS sample_count,
           {ratio('sum(rssi_centi * sample_count)', '(sum(sample_count) FILTER (rssi_centi IS NOT NULL)) * 100')}
             AS avg_valid_rssi,
           CAST(min(level_min) AS DOUBLE) AS min_rssi, CAST(max(level_max) AS DOUBLE) AS max_rssi,
           max(last_sample_time) AS last_sample_time, {big('sum(weak_signal_sample_count)')} AS weak_signal_sample_count
    FROM inwin GROUP BY stat_hour""", **in_hours("wifi_hourly"))
oracle("wifi_fleet", f"""
    SELECT max(wi_time) AS wifi_anchor_time, count(*) AS active_robot_count, count(wi_time) AS wifi_known_robot_count,
           count(*) FILTER (wifi_freshness_status = 'CURRENT') AS wifi_current_robot_count,
           count(*) FILTER (wifi_freshness_status <> 'CURRENT') AS wifi_timed_out_robot_count,
           {big("coalesce(sum(wi_n) FILTER (wifi_freshness_status = 'CURRENT'), 0)")} AS wifi_sample_count,
           {ratio("sum(rssi_centi) FILTER (wifi_freshness_status = 'CURRENT')",
                  "count(rssi_centi) FILTER (wifi_freshness_status = 'CURRENT') * 100")} AS avg_current_rssi,
           max(wi_load) AS latest_wifi_dws_load_time
    FROM fleet""", **FLEET)
oracle("wifi_robot_rows", f"""
    SELECT master_robot_id, robot_code, wifi_freshness_status = 'CURRENT' AS wifi_is_current, wifi_freshness_status,
           CASE WHEN wifi_freshness_status = 'CURRENT' THEN CAST(rssi_centi AS DOUBLE) / 100 END AS current_rssi,
           CASE WHEN wifi_freshness_status = 'CURRENT' THEN wi_n ELSE 0 END AS wifi_sample_count,
           CASE WHEN wifi_freshness_status = 'CURRENT' THEN wi_weak ELSE 0 END AS weak_signal_sample_count,
           CASE WHEN wifi_freshness_status = 'CURRENT' THEN {percent('wi_weak', 'wi_n')} END AS weak_signal_rate,
           CASE WHEN wifi_freshness_status = 'CURRENT' THEN CAST(level_min AS DOUBLE) END AS min_valid_rssi
    FROM fleet""", **FLEET)
oracle("status_coverage", f"""
    SELECT s.master_robot_id, s.robot_code, {big('coalesce(sum(h.sample_count), 0)')} AS status_sample_count,
           {big('coalesce(sum(h.online_sample_count), 0)')} AS online_sample_count,
           {big('coalesce(sum(h.error_sample_count), 0)')} AS error_sample_count,
           {ratio('sum(h.speed_milli * h.sample_count)', 'sum(h.sample_count) * 1000', 4)} AS weighted_avg_speed_mps,
           max(h.stat_hour) AS latest_status_hour
    FROM scope s LEFT JOIN inwin h
      ON h.robot_code = s.robot_code OR h.robot_code = CAST(s.master_robot_id AS VARCHAR)
    GROUP BY 1, 2""", **in_hours("status_hourly"))
oracle("overlay_robots", """
    SELECT master_robot_id, robot_code, CAST(soc AS DOUBLE) / 100 AS battery_soc,
           CASE WHEN wifi_freshness_status = 'CURRENT' THEN CAST(rssi_centi AS DOUBLE) / 100 END AS current_rssi,
           CASE WHEN wifi_freshness_status = 'CURRENT' THEN wi_n ELSE 0 END AS wifi_sample_count, wifi_freshness_status,
           greatest(coalesce(st_time, source_event_time), ba_time, wi_time) AS latest_data_time
    FROM fleet""", **FLEET)
oracle("offline_ids", """
    SELECT 'offline' AS list, robot_code FROM fleet WHERE online_status <> 'ONLINE'
    UNION ALL SELECT 'low_battery', robot_code FROM fleet WHERE soc BETWEEN 0 AND 2000""", **FLEET)
oracle("text_search", """
    SELECT s.master_robot_id, s.robot_code, m.serial_number AS robot_serial_number
    FROM scope s JOIN robot_master m ON m.id = s.master_robot_id
    WHERE contains(lower(s.robot_code), '_1') OR contains(lower(m.serial_number), '_1')
       OR contains(CAST(s.master_robot_id AS VARCHAR), '_1')""")
oracle("natural_sort_rank", """
    SELECT robot_code, lower(regexp_replace(robot_code, '[0-9]+$', '')) AS prefix,
           CAST(regexp_extract(robot_code, '([0-9]+)$', 1) AS BIGINT) AS number, lower(robot_code) AS lowered
    FROM scope""")

# Fleet rows have no error, charging or raw signal fields, so these rules can fire:
DIAGNOSIS = {
    **FLEET,
    "diag": """
        SELECT *, CASE status_freshness_status WHEN 'DWS_REFRESH_TIMEOUT' THEN 'DWS_REFRESH_TIMEOUT'
                       WHEN 'DWS_SOURCE_LAG' THEN 'DWS_SOURCE_LAG' WHEN 'SOURCE_TIMEOUT' THEN 'DWS_SOURCE_TIMEOUT'
                       WHEN 'MISSING' THEN 'DWS_STATUS_MISSING'
                       ELSE CASE WHEN soc BETWEEN 0 AND 2000 THEN 'LOW_BATTERY_CURRENT' END END AS rule_id
        FROM fleet""",
    "rated": """
        SELECT *, CASE rule_id WHEN 'DWS_REFRESH_TIMEOUT' THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
               CASE rule_id WHEN 'DWS_SOURCE_TIMEOUT' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence
        FROM diag WHERE rule_id IS NOT NULL""",
    "alerts": """
        SELECT master_robot_id, status_freshness_status AS code, 'data-stale' AS type,
               coalesce(st_load, load_time) AS data_time
        FROM fleet WHERE status_freshness_status <> 'CURRENT'
        UNION ALL
        SELECT master_robot_id, 'LOW_BATTERY', 'low-battery', coalesce(ba_time, source_event_time)
        FROM fleet WHERE soc BETWEEN 0 AND 2000""",
}
oracle("robot_diagnosis", """
    SELECT robot_code AS robot_id, master_robot_id, robot_type, confidence, severity, rule_id AS rule_ids FROM rated""",
       **DIAGNOSIS)
oracle("diagnostic_groups", """
    SELECT rule_id AS rules, severity, CAST(count(*) AS BIGINT) AS robot_count FROM rated GROUP BY 1, 2""", **DIAGNOSIS)
oracle("alert_causes", "SELECT * FROM alerts", **DIAGNOSIS)
oracle("alert_groups", """
    SELECT code, type, count(*) AS robot_count, max(data_time) AS latest_time FROM alerts GROUP BY 1, 2""", **DIAGNOSIS)

# -- daily rollups and outcomes --------------------------------------------------

ROLLUP = {"inwin": """
    SELECT * FROM job_daily
    WHERE job_type_code = '__ALL__' AND robot_mode_id = '__ALL__'
      AND robot_code IN (SELECT robot_reference FROM bridge)
      AND stat_date >= (SELECT max(stat_date) FROM job_daily
                        WHERE robot_code IN (SELECT robot_reference FROM bridge)) - INTERVAL 89 DAY"""}
oracle("daily_totals", f"""
    SELECT stat_date, {', '.join(f'{big(f"sum({name})")} AS {name}' for name in
    ('job_count', 'distinct_job_count', 'completed_status_count', 'failed_status_count'))}
    FROM inwin GROUP BY 1""", **ROLLUP)
oracle("daily_success_rate", f"""
    SELECT stat_date, {big('sum(completed_status_count)')} AS completed_status_count,
           {big('sum(failed_status_count)')} AS failed_status_count,
           {percent('sum(completed_status_count)', 'sum(completed_status_count + failed_status_count)')}
             AS success_rate_percent
    FROM inwin GROUP BY 1""", **ROLLUP)
oracle("queue_daily_totals", f"""
    SELECT stat_date, {', '.join(f'{big(f"sum({name})")} AS {name}' for name in
    ('queue_count', 'distinct_queue_count', 'completed_status_count', 'failed_status_count'))},
           {ratio('sum(avg_duration_seconds)', 'count(avg_duration_seconds)')} AS avg_duration_seconds
    FROM queue_daily WHERE robot_code IN (SELECT robot_reference FROM bridge) GROUP BY 1""")

OUTCOMES = {
    "item": """
        SELECT CAST(event_time AS DATE) AS d, coalesce(nullif(trim(robot_code), ''), nullif(trim(robot_id), ''), 'UNKNOWN')
                 AS robot, nullif(trim(queue_id), '') AS q,
               max(CASE WHEN upper(trim(queue_status)) IN ('COMPLETED', 'COMPLEATED', 'COMPLETE', 'SUCCESS', 'SUCCEEDED',
                        'DONE', 'FINISHED', '完成', '成功') THEN 1 ELSE 0 END) AS done,
               min(CASE upper(trim(queue_status)) WHEN 'ABORTED' THEN 1 WHEN 'ERROR' THEN 2 WHEN '异常' THEN 2
                        WHEN 'FAILED' THEN 3 WHEN 'FAIL' THEN 3 WHEN '失败' THEN 3 WHEN 'CANCELLED' THEN 4
                        WHEN 'CANCELED' THEN 4 WHEN '取消' THEN 4 ELSE 99 END) AS fr,
               max(event_time) AS latest
        FROM queue_attempts WHERE robot_code IN (SELECT robot_reference FROM bridge) GROUP BY 1, 2, 3""",
    "outcomes": """
        SELECT CASE fr WHEN 1 THEN 'ABORTED' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'FAILED' ELSE 'CANCELLED' END
                 AS failure_outcome, coalesce(m.name, robot) AS robot_code, robot AS source_robot_reference,
               count(*) AS failure_count, max(latest) AS latest_failure_time
        FROM item LEFT JOIN robot_master m ON m.id = TRY_CAST(robot AS INTEGER)
        WHERE done = 0 AND fr < 99 GROUP BY 1, 2, 3""",
}
oracle("unsuccessful_outcomes", "SELECT * FROM outcomes", **OUTCOMES)
oracle("outcome_groups", f"""
    SELECT failure_outcome, {big('sum(failure_count)')} AS failure_count, count(DISTINCT robot_code) AS robot_count,
           max(latest_failure_time) AS latest_failure_time FROM outcomes GROUP BY 1""", **OUTCOMES)

WORKLOAD = {
    **ROLLUP, **FLEET,
    "workload": f"""
        SELECT s.master_robot_id, s.robot_code, s.robot_type,
               {big('coalesce(sum(j.distinct_job_count), 0)')} AS assigned_task_count,
               {big('coalesce(sum(j.completed_status_count), 0)')} AS completed_task_count,
               {big('coalesce(sum(j.failed_status_count), 0)')} AS unsuccessful_task_count,
               min(j.stat_date) AS first_workload_date, max(j.stat_date) AS latest_workload_date
        FROM scope s LEFT JOIN inwin j
          ON j.robot_code = s.robot_code OR j.robot_code = CAST(s.master_robot_id AS VARCHAR)
        GROUP BY 1, 2, 3""",
    "grp": f"""
        SELECT robot_type, count(*) AS robot_count, {big('sum(assigned_task_count)')} AS total_assigned_tasks,
               count(*) FILTER (assigned_task_count = 0) AS zero_task_robot_count,
               arg_min(robot_code, (-assigned_task_count, robot_code)) AS top_robot_id,
               max(assigned_task_count) AS top_robot_task_count,
               coalesce({percent('max(assigned_task_count)', 'sum(assigned_task_count)', 1)}, 0) AS top_robot_share_percent,
               coalesce(median(assigned_task_count) FILTER (assigned_task_count > 0), 0) AS median_active_robot_tasks
        FROM workload GROUP BY 1""",
}
oracle("workload_per_robot", "SELECT * FROM workload", **WORKLOAD)
oracle("workload_concentration", """
    SELECT robot_type, robot_count, total_assigned_tasks, zero_task_robot_count,
           CAST(0 AS BIGINT) AS current_online_zero_task_robot_count,
           zero_task_robot_count AS telemetry_unavailable_zero_task_robot_count,
           CAST(0 AS BIGINT) AS charging_zero_task_robot_count, CAST(0 AS BIGINT) AS currently_observable_idle_robot_count,
           top_robot_id, top_robot_task_count, top_robot_share_percent, median_active_robot_tasks
    FROM grp""", **WORKLOAD)
oracle("workload_classification", """
    SELECT w.robot_code AS robot_id, w.master_robot_id, w.robot_type, w.assigned_task_count,
           CASE WHEN g.total_assigned_tasks = 0 THEN 'NO_DATA' WHEN w.assigned_task_count = 0 THEN 'TELEMETRY_UNAVAILABLE'
                WHEN g.top_robot_id = w.robot_code AND g.top_robot_share_percent >= 60 AND g.robot_count >= 3
                  THEN 'CONCENTRATED' ELSE 'BALANCED' END AS classification
    FROM workload w JOIN grp g USING (robot_type)""", **WORKLOAD)
oracle("workload_assessment", f"""
    SELECT CASE WHEN c > 0 THEN 'WARNING' WHEN z > 0 THEN 'WATCH' ELSE 'HEALTHY' END AS workload_severity,
           CASE WHEN c = 0 THEN 'NO_SEVERE_CONCENTRATION' WHEN z > 0 THEN 'CAPACITY_EVIDENCE_LIMITED'
                ELSE 'UNRESOLVED' END AS cause_status,
           c AS concentrated_type_count, z AS zero_task_robot_count, z AS telemetry_unavailable_zero_task_robot_count,
           CAST(0 AS BIGINT) AS currently_observable_idle_robot_count
    FROM (SELECT count(*) FILTER (total_assigned_tasks > 0 AND top_robot_share_percent >= 60 AND robot_count >= 3) AS c,
                 {big('sum(zero_task_robot_count)')} AS z FROM grp)""", **WORKLOAD)
oracle("workload_highlights", """
    SELECT w.robot_code AS robot_id, w.assigned_task_count,
           CASE WHEN g.top_robot_id = w.robot_code AND g.top_robot_share_percent >= 60 AND g.robot_count >= 3
                THEN 'CONCENTRATED' ELSE 'BALANCED' END AS classification
    FROM workload w JOIN grp g USING (robot_type) WHERE w.assigned_task_count > 0
    ORDER BY w.assigned_task_count DESC, w.robot_code LIMIT 6""", **WORKLOAD)
oracle("profile_task_breakdown", f"""
    SELECT CASE WHEN job_type_code = '__ALL__' THEN 'ALL TASK OUTCOMES'
                ELSE coalesce(nullif(trim(job_type_code), ''), 'NOT_REPORTED') END AS job_type_code,
           CASE WHEN robot_mode_id = '__ALL__' THEN 'ALL MODES'
                ELSE coalesce(nullif(trim(robot_mode_id), ''), 'NOT_REPORTED') END AS robot_mode_id,
           CASE WHEN job_type_code = '__ALL__' AND robot_mode_id = '__ALL__' THEN 'Queue outcomes across all task types'
                ELSE coalesce(nullif(trim(robot_mode_detail), ''), 'Not reported') END AS robot_mode_detail,
           {', '.join(f'{big(f"sum({name})")} AS {name}' for name in
            ('job_count', 'distinct_job_count', 'completed_status_count', 'failed_status_count'))},
           max(last_job_start_time) AS latest_job_time
    FROM job_daily GROUP BY 1, 2, 3""")

# -- executions and batteries ------------------------------------------------------

RUNS = {
    "lim": """
        SELECT job_id, sub, limit_ms FROM (
            SELECT job_id, coalesce(subjob_id, -1) AS sub, limit_ms,
                   row_number() OVER (PARTITION BY job_id, coalesce(subjob_id, -1) ORDER BY id DESC) AS rn
            FROM duration_limit) WHERE rn = 1""",
    "runs": """
        SELECT r.*, s.robot_code, s.robot_type, s.master_robot_id FROM task_run r JOIN scope s ON s.master_robot_id = r.amr_id""",
    "timed": """
        SELECT runs.*, lim.limit_ms, end_time >= start_time AS ok, date_diff('millisecond', start_time, end_time) AS ms,
               date_diff('second', start_time, end_time) AS sec
        FROM runs LEFT JOIN lim ON lim.job_id = runs.job_id AND lim.sub = coalesce(runs.subjob_id, -1)""",
    "timing": f"""
        SELECT master_robot_id, robot_code, robot_type, count(*) AS task_execution_count,
               count(*) FILTER (ok) AS duration_complete_count,
               count(*) FILTER (ok AND limit_ms > 0) AS duration_reference_count,
               count(*) FILTER (ok AND limit_ms > 0 AND ms <= limit_ms) AS on_time_count,
               {percent('count(*) FILTER (ok AND limit_ms > 0 AND ms <= limit_ms)',
                        'count(*) FILTER (ok AND limit_ms > 0)')} AS on_time_rate_percent,
               {ratio('sum(ms) FILTER (ok)', 'count(*) FILTER (ok) * 1000')} AS avg_actual_duration_seconds,
               max(sec) FILTER (ok) AS max_actual_duration_seconds,
               count(*) FILTER (ok AND sec > 3600) AS over_1_hour_duration_count, min(start_time) AS first_task_time,
               max(start_time) AS last_task_time, false AS window_truncated
        FROM timed GROUP BY 1, 2, 3""",
    "waits": f"""
        SELECT master_robot_id, robot_code, robot_type, count(*) AS linked_queue_count,
               {ratio("sum(date_diff('millisecond', enqueued_at, start_time))", 'count(*) * 1000')}
                 AS avg_queue_wait_seconds,
               max(date_diff('second', enqueued_at, start_time)) AS max_queue_wait_seconds,
               count(*) FILTER (date_diff('second', enqueued_at, start_time) > 300) AS over_5_minute_queue_count
        FROM runs JOIN queue_source q ON q.id = runs.queue_id WHERE start_time >= enqueued_at GROUP BY 1, 2, 3""",
    "segs": f"""
        SELECT master_robot_id, robot_code, robot_type, ty.name AS subjob_type_name, sj.name AS subjob_name,
               count(*) AS completed_segment_count, {ratio('sum(ms)', 'count(*) * 1000')} AS avg_segment_duration_seconds,
               max(sec) AS max_segment_duration_seconds
        FROM timed JOIN subjob sj ON sj.id = subjob_id LEFT JOIN project ty ON ty.id = sj.type_id
        WHERE ok GROUP BY 1, 2, 3, 4, 5""",
    "bs": """
        SELECT s.master_robot_id, s.robot_code, s.robot_type, pc_timestamp, batt_level,
               lead(pc_timestamp) OVER (PARTITION BY amr_id ORDER BY pc_timestamp) AS nx
        FROM battery_history b JOIN scope s ON s.master_robot_id = b.amr_id
        WHERE pc_timestamp >= (SELECT max(pc_timestamp) FROM battery_history
                               WHERE amr_id IN (SELECT master_robot_id FROM scope)) - INTERVAL 720 HOUR""",
    "bi": """
        SELECT *, CASE WHEN nx IS NULL OR date_diff('second', pc_timestamp, nx) > 43200 THEN 0
                       ELSE date_diff('second', pc_timestamp, nx) END AS obs FROM bs""",
    "share": f"""
        SELECT master_robot_id, robot_code, robot_type, count(*) AS sample_count, {big('sum(obs)')} AS observed_seconds,
               {big('sum(CASE WHEN batt_level > 60 THEN obs ELSE 0 END)')} AS above_60_seconds,
               {percent('sum(CASE WHEN batt_level > 60 THEN obs ELSE 0 END)', 'sum(obs)')} AS above_60_time_share_percent,
               {percent('sum(obs)', 'CAST(2592000 AS BIGINT)')} AS window_coverage_percent,
               min(pc_timestamp) AS first_sample_time, max(pc_timestamp) AS last_sample_time
        FROM bi GROUP BY 1, 2, 3 HAVING sum(obs) > 0""",
}
oracle("task_timing", "SELECT * FROM timing", **RUNS)
oracle("queue_wait", "SELECT * FROM waits", **RUNS)
oracle("segment_durations", "SELECT * FROM segs", **RUNS)
oracle("battery_time_share", "SELECT master_robot_id AS amr_id, * EXCLUDE (master_robot_id) FROM share", **RUNS)
oracle("sample_share", f"""
    SELECT robot_code, count(*) AS sample_count, count(*) FILTER (batt_level > 60) AS above_60_sample_count,
           min(pc_timestamp) AS first_sample_time, max(pc_timestamp) AS last_sample_time,
           {percent('count(*) FILTER (batt_level > 60)', 'count(*)')} AS above_60_sample_share_percent
    FROM battery_history b JOIN scope s ON s.master_robot_id = b.amr_id
    WHERE pc_timestamp >= (SELECT max(pc_timestamp) FROM battery_history) - INTERVAL 720 HOUR GROUP BY 1""")
METRICS = {
    **RUNS,
    "metrics": f"""
        SELECT t.*, w.*, b.*, s.* FROM (
            SELECT {big('sum(task_execution_count)')} AS task_execution_count,
                   {big('sum(duration_complete_count)')} AS duration_complete_count,
                   {big('sum(duration_reference_count)')} AS duration_reference_count,
                   count(*) FILTER (duration_reference_count > 0) AS duration_reference_robot_count,
                   {big('sum(on_time_count)')} AS on_time_count,
                   {percent('sum(on_time_count)', 'sum(duration_reference_count)')} AS on_time_rate_percent,
                   {ratio('sum(CAST(round(avg_actual_duration_seconds * 100) AS HUGEINT) * duration_complete_count)',
                          'sum(duration_complete_count) * 100')} AS avg_actual_duration_seconds,
                   max(max_actual_duration_seconds) AS max_actual_duration_seconds,
                   {big('sum(over_1_hour_duration_count)')} AS over_1_hour_duration_count, 90 AS on_time_target_percent
            FROM timing) t, (
            SELECT {big('sum(linked_queue_count)')} AS linked_queue_count,
                   {ratio('sum(CAST(round(avg_queue_wait_seconds * 100) AS HUGEINT) * linked_queue_count)',
                          'sum(linked_queue_count) * 100')} AS avg_queue_wait_seconds,
                   max(max_queue_wait_seconds) AS max_queue_wait_seconds,
                   {big('sum(over_5_minute_queue_count)')} AS over_5_minute_queue_count FROM waits) w, (
            SELECT count(*) AS battery_measured_robot_count,
                   count(*) FILTER (window_coverage_percent >= 80) AS battery_reliable_robot_count FROM share) b, (
            SELECT {big('sum(completed_segment_count)')} AS completed_segment_count,
                   count(DISTINCT coalesce(subjob_type_name, '') || '|' || coalesce(subjob_name, ''))
                     AS segment_definition_count,
                   {big("coalesce(sum(completed_segment_count) FILTER (regexp_matches(upper(coalesce(subjob_type_name, '')"
                        " || ' ' || subjob_name), 'LOAD|UNLOAD|PICK|DROP')), 0)")}
                     AS loading_or_unloading_segment_count FROM segs) s""",
}
oracle("operational_metrics", "SELECT * FROM metrics", **METRICS)

oracle("on_time_ranking", f"""
    SELECT robot_code, {percent('on_time_count', 'duration_reference_count')} AS value,
           CASE WHEN on_time_count * 100 >= duration_reference_count * 90 THEN 'healthy' ELSE 'warning' END AS tone
    FROM timing WHERE duration_reference_count > 0""", **RUNS)
oracle("queue_wait_ranking", """
    SELECT robot_code, avg_queue_wait_seconds AS value,
           CASE WHEN avg_queue_wait_seconds > 300 THEN 'warning' ELSE 'blue' END AS tone FROM waits""", **RUNS)
oracle("battery_share_ranking", """
    SELECT robot_code, above_60_time_share_percent AS value,
           CASE WHEN window_coverage_percent >= 80 THEN 'violet' ELSE 'muted' END AS tone FROM share""", **RUNS)

# -- readiness ---------------------------------------------------------------------

oracle("event_audit_coverage", """
    SELECT source_schema, source_table, event_category, event_type, count(*) AS event_count,
           count(robot_id) AS robot_attributed_event_count, min(event_time) AS first_event_time,
           max(event_time) AS latest_event_time, max(dwd_load_time) AS latest_load_time
    FROM operation_event GROUP BY 1, 2, 3, 4""")
SOURCES = {"src": """
    SELECT 'ODS' AS source_schema, 'AMR_Queue' AS source_table, max(id) AS source_max_ods_row_id FROM queue_source
    UNION ALL SELECT 'ODS', 'TA_AMR', max(id) FROM task_run
    UNION ALL SELECT 'ODS', 'MA_AMR_Project_Assignment', max(id) FROM robot_master"""}
oracle("watermark_currency", """
    SELECT w.source_schema, w.source_table, w.last_ods_row_id, src.source_max_ods_row_id
    FROM watermark w JOIN src ON src.source_schema = w.source_schema AND src.source_table = w.source_table
    WHERE w.last_ods_row_id >= src.source_max_ods_row_id""", **SOURCES)
READY = {
    **SOURCES,
    "inq": """
        SELECT * FROM queue_fact WHERE robot_code IN (SELECT robot_code FROM scope)
           OR robot_id IN (SELECT CAST(master_robot_id AS VARCHAR) FROM scope)""",
    "ready": """
        SELECT (SELECT max(event_time) FROM inq) AS queue_history_anchor_time,
               (SELECT count(*) FROM inq WHERE event_time >= (SELECT max(event_time) FROM inq) - INTERVAL 90 DAY)
                 AS queue_row_count,
               (SELECT count(duration_seconds) FROM inq
                WHERE event_time >= (SELECT max(event_time) FROM inq) - INTERVAL 90 DAY) AS queue_duration_row_count,
               (SELECT count(*) FROM task_run WHERE amr_id IN (SELECT master_robot_id FROM scope)) AS subjob_row_count,
               (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT master_robot_id FROM scope))
                 AS dispatch_assignment_row_count,
               (SELECT count(*) FROM orders) AS dispatch_audit_row_count, CAST(5 AS BIGINT) AS dispatch_audit_field_count,
               (SELECT count(*) FROM operation_event) AS operation_event_row_count,
               (SELECT count(robot_id) FROM operation_event) AS operation_event_robot_attributed_count,
               (SELECT max(event_time) FROM operation_event) AS operation_event_latest_time,
               (SELECT count(*) FROM watermark) AS audit_watermark_source_count,
               (SELECT count(*) FROM watermark w JOIN src ON src.source_table = w.source_table
                WHERE w.last_ods_row_id >= src.source_max_ods_row_id) AS audit_sources_current_count,
               (SELECT count(*) FROM ev WHERE event_type = 'error') AS incident_row_count,
               (SELECT count(*) FROM ev WHERE event_type = 'error') AS incident_evidence_row_count""",
}
oracle("readiness", "SELECT * FROM ready", **READY)
oracle("measurement_gaps", """
    SELECT position, metric, status FROM (
        SELECT 1 AS position, 'On-time rate vs. estimated task duration' AS metric,
               CASE WHEN duration_reference_count > 0 THEN 'SUPPORTED_WITH_ASSUMPTION' ELSE 'NOT_MEASURABLE' END AS status
        FROM metrics
        UNION ALL SELECT 2, 'Task execution duration',
               CASE WHEN duration_complete_count > 0 THEN 'SUPPORTED' ELSE 'NOT_MEASURABLE' END FROM metrics
        UNION ALL SELECT 3, 'Queue waiting time',
               CASE WHEN linked_queue_count > 0 THEN 'SUPPORTED_WITH_DERIVATION' ELSE 'NOT_MEASURABLE' END FROM metrics
        UNION ALL SELECT 4, 'Route congestion and loading/unloading delay',
               CASE WHEN completed_segment_count > 0 THEN 'PARTIAL' ELSE 'NOT_MEASURABLE' END FROM metrics
        UNION ALL SELECT 5, 'Battery above 60% time share',
               CASE WHEN battery_measured_robot_count > 0 THEN 'SUPPORTED_WITH_COVERAGE' ELSE 'NOT_MEASURABLE' END
        FROM metrics
        UNION ALL SELECT 6, 'Dispatch optimality',
               CASE WHEN dispatch_audit_field_count >= 7 AND dispatch_audit_row_count > 0 THEN 'SUPPORTED'
                    WHEN dispatch_assignment_row_count > 0 THEN 'PARTIAL' ELSE 'NOT_MEASURABLE' END FROM ready
        UNION ALL SELECT 7, 'Unified event and incident audit trail',
               CASE WHEN operation_event_row_count = 0 THEN 'NOT_MEASURABLE'
                    WHEN incident_row_count > 0 AND incident_evidence_row_count > 0 THEN 'SUPPORTED' ELSE 'PARTIAL' END
        FROM ready
        UNION ALL SELECT 8, 'Task cumulative mileage', 'NOT_MEASURABLE')""", **METRICS, **READY)
ASSESSMENT = {
    **METRICS, **READY, **WORKLOAD, **DIAGNOSIS, **in_hours("status_hourly"),
    "covered": """
        SELECT count(DISTINCT s.master_robot_id) AS c FROM scope s JOIN inwin h
          ON h.robot_code = s.robot_code OR h.robot_code = CAST(s.master_robot_id AS VARCHAR)""",
    "jobwin": ROLLUP["inwin"],
}
ASSESSMENT["workload"] = WORKLOAD["workload"].replace("inwin", "jobwin")
ASSESSMENT = {name: ASSESSMENT[name] for name in sorted(
    ASSESSMENT, key=lambda name: (name in ("workload", "grp"), name == "grp"))}
oracle("fleet_assessment", f"""
    SELECT CASE WHEN crit > 0 THEN 'CRITICAL' WHEN n > 0 OR conc > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS severity,
           CASE WHEN cov < total OR unresolved > 0 THEN 'LIMITED' ELSE 'SUPPORTED' END AS confidence,
           CASE WHEN cov = total AND unmeasured = 0 THEN 'HEALTHY' ELSE 'WARNING' END AS data_quality_severity,
           {percent('cov', 'total', 1)} AS status_coverage_percent, n AS diagnostic_count, crit AS critical_count,
           unmeasured AS rssi_measurement_unavailable_robot_count, unresolved AS unresolved_disconnect_count, cov AS status_coverage_robot_count,
           total AS total_robot_count, nm AS not_measurable_count,
           CASE WHEN conc > 0 THEN 'WARNING' WHEN z > 0 THEN 'WATCH' ELSE 'HEALTHY' END AS workload_severity,
           CASE WHEN conc = 0 THEN 'NO_SEVERE_CONCENTRATION' WHEN z > 0 THEN 'CAPACITY_EVIDENCE_LIMITED'
                ELSE 'UNRESOLVED' END AS cause_status
    FROM (SELECT (SELECT count(*) FROM rated) AS n, (SELECT count(*) FROM rated WHERE severity = 'CRITICAL') AS crit,
                 (SELECT count(*) FROM rated WHERE rule_id = 'WIFI_RSSI_MEASUREMENT_UNAVAILABLE') AS unmeasured,
                 (SELECT count(*) FROM rated WHERE rule_id IN ('DISCONNECT_EVIDENCE_STALE', 'SOURCE_TELEMETRY_ALL_TOPICS_STOPPED'))
                   AS unresolved,
                 (SELECT c FROM covered) AS cov, (SELECT count(*) FROM scope) AS total,
                 (SELECT count(*) FROM grp WHERE total_assigned_tasks > 0 AND top_robot_share_percent >= 60
                    AND robot_count >= 3) AS conc,
                 (SELECT {big('sum(zero_task_robot_count)')} FROM grp) AS z,
                 (SELECT CAST(1 + (duration_reference_count = 0)::INT + (duration_complete_count = 0)::INT
                         + (linked_queue_count = 0)::INT + (completed_segment_count = 0)::INT
                         + (battery_measured_robot_count = 0)::INT AS BIGINT) FROM metrics)
                 + (SELECT CAST((dispatch_assignment_row_count = 0)::INT + (operation_event_row_count = 0)::INT AS BIGINT)
                    FROM ready) AS nm)""", **ASSESSMENT)
oracle("coverage_profile", """
    SELECT count(*) AS task_row_count, count(start_time) AS start_time_row_count, count(end_time) AS end_time_row_count,
           count(*) FILTER (subjob_id > 0) AS subjob_row_count, min(start_time) AS first_time, max(start_time) AS last_time
    FROM task_run WHERE start_time >= (SELECT max(start_time) FROM task_run) - INTERVAL 3650 DAY""")
oracle("source_anchors", """
    SELECT 'ODS.AMR_Queue' AS source_object, min(id) AS min_ods_row_id, max(id) AS max_ods_row_id,
           min(enqueued_at) AS min_event_time, max(enqueued_at) AS max_event_time FROM queue_source
    UNION ALL SELECT 'ODS.TA_AMR', min(id), max(id), min(start_time), max(start_time) FROM task_run
    UNION ALL SELECT 'ODS.MA_AMR_Project_Assignment', min(id), max(id), min(updated_at), max(updated_at)
    FROM robot_master""")
oracle("row_counts", """
    SELECT 'task_run' AS table_name, count(*) AS row_count FROM task_run
    UNION ALL SELECT 'queue_fact', count(*) FROM queue_fact
    UNION ALL SELECT 'operation_event', count(*) FROM operation_event
    UNION ALL SELECT 'wifi_history', count(*) FROM wifi_history""")
oracle("latest_batches", """
    SELECT o_orderkey AS batch_id, o_orderdate AS batch_start_time,
           o_orderdate + to_minutes(CAST(price_k AS BIGINT)) AS batch_end_time, o_orderstatus AS batch_status,
           CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS error_message
    FROM ord ORDER BY o_orderkey DESC LIMIT 10""")

# -- hourly task states ---------------------------------------------------------------

STATES = ("executing_seconds", "charging_seconds", "waiting_seconds", "no_task_seconds", "data_unavailable_seconds")
COUNTS = ("accepted_queue_count", "task_started_count", "subtask_started_count", "task_completed_count")
SUMS = ", ".join(f"{big(f'sum({name})')} AS {name}" for name in STATES + COUNTS)
SUMMARY = {"summ": f"""
    SELECT count(*) AS hourly_row_count, count(DISTINCT robot_code) AS robot_count, {SUMS},
           count(*) FILTER (data_unavailable_seconds > 0) AS data_gap_robot_hour_count,
           count(*) FILTER (data_unavailable_seconds = 3600) AS data_exception_robot_hour_count,
           count(DISTINCT robot_code) FILTER (data_unavailable_seconds = 3600) AS data_exception_robot_count,
           max(last_source_event_time) AS latest_source_event_time, max(dws_load_time) AS latest_dws_load_time,
           (SELECT {big('sum(assigned_task_count)')} FROM assigned_task_hourly) AS queue_assigned_task_count,
           (SELECT {big('sum(completed_task_count)')} FROM assigned_task_hourly) AS queue_completed_task_count,
           (SELECT count(DISTINCT robot_code) FROM assigned_task_hourly) AS task_activity_robot_count
    FROM task_hourly"""}
oracle("task_state_summary", f"SELECT {big('data_gap_robot_hour_count')} AS data_gap_robot_hour_count,"
       " * EXCLUDE (data_gap_robot_hour_count) FROM summ", **SUMMARY)
oracle("state_coverage_quality", f"""
    SELECT {percent('data_unavailable_seconds', ' + '.join(STATES))} AS unavailable_percent,
           data_gap_robot_hour_count - data_exception_robot_hour_count AS partial_gap_robot_hours,
           data_exception_robot_hour_count FROM summ""", **SUMMARY)
oracle("robot_picker", """
    SELECT robot_code, max(robot_id) AS robot_id, max(dws_load_time) AS latest_dws_load_time FROM task_hourly GROUP BY 1""")
oracle("state_rollup_hour", f"SELECT stat_hour, robot_code, {SUMS} FROM task_hourly GROUP BY 1, 2")
oracle("state_rollup_day", f"""
    SELECT time_bucket(INTERVAL '1 day', stat_hour) AS stat_hour, robot_code, {SUMS} FROM task_hourly GROUP BY 1, 2""")
oracle("state_exceptions", """
    SELECT e.stat_hour, e.robot_code, e.robot_id, e.data_unavailable_seconds,
           coalesce(b.sample_count, 0) AS battery_event_count, coalesce(b.charging_sample_count, 0) AS charging_sample_count,
           e.task_event_count, b.last_sample_time AS battery_event_time_in_hour,
           e.last_source_event_time AS task_event_time_in_hour,
           (SELECT max(p.last_sample_time) FROM battery_hourly p WHERE p.robot_code = e.robot_code
              AND p.stat_hour = (SELECT max(x.stat_hour) FROM battery_hourly x
                                 WHERE x.robot_code = e.robot_code AND x.stat_hour < e.stat_hour AND x.sample_count > 0))
             AS last_battery_event_time_before_hour,
           CASE WHEN e.data_unavailable_seconds = 3600 AND coalesce(b.sample_count, 0) = 0 AND e.task_event_count = 0
                  THEN 'FULL_NO_BATTERY_OR_TASK_EVIDENCE'
                WHEN e.data_unavailable_seconds = 3600 AND coalesce(b.sample_count, 0) = 0
                  THEN 'FULL_TASK_EVENT_WITHOUT_BATTERY_EVIDENCE'
                WHEN e.data_unavailable_seconds = 3600 THEN 'FULL_STATE_COVERAGE_GAP_UNRESOLVED'
                ELSE 'PARTIAL_STATE_COVERAGE_GAP' END AS exception_type
    FROM top e LEFT JOIN battery_hourly b ON b.robot_code = e.robot_code AND b.stat_hour = e.stat_hour""",
       top="""
        SELECT *, accepted_queue_count + task_started_count + subtask_started_count + task_completed_count
                    AS task_event_count
        FROM task_hourly WHERE data_unavailable_seconds > 0""")
oracle("asof_before", """
    SELECT t.robot_code, t.stat_hour, t.data_unavailable_seconds,
           arg_max(b.last_sample_time, b.stat_hour) AS prior_battery_time
    FROM task_hourly t LEFT JOIN battery_hourly b
      ON b.robot_code = t.robot_code AND b.stat_hour < t.stat_hour AND b.sample_count > 0
    GROUP BY 1, 2, 3""")
oracle("idle_split", f"""
    SELECT cause, seconds, {percent('seconds', 'whole')} AS share_percent FROM (
        SELECT unnest(['no_task', 'waiting', 'charging']) AS cause, unnest([n, w, c]) AS seconds, n + w + c AS whole
        FROM (SELECT {big('sum(no_task_seconds)')} AS n, {big('sum(waiting_seconds)')} AS w,
                     {big('sum(charging_seconds)')} AS c FROM task_hourly))""")
oracle("idle_minutes_trend", """
    SELECT time_bucket(INTERVAL '1 day', stat_hour) AS stat_hour,
           CAST(sum(no_task_seconds + waiting_seconds + charging_seconds) AS DOUBLE) / 60 AS idle_minutes
    FROM task_hourly GROUP BY 1""")
oracle("usage_minutes_trend", """
    SELECT time_bucket(INTERVAL '1 day', stat_hour) AS stat_hour, 'All robots' AS series,
           CAST(sum(executing_seconds) AS DOUBLE) / 60 AS executing_minutes
    FROM task_hourly GROUP BY 1""")
oracle("leaderboard_top10", f"""
    SELECT task_label, {big('sum(assigned_task_count)')} AS assigned_task_count,
           {big('sum(completed_task_count)')} AS completed_task_count, count(DISTINCT robot_code) AS robot_count,
           min(first_assigned_at) AS first_assigned_at, max(last_assigned_at) AS last_assigned_at
    FROM assigned_task_hourly GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
oracle("calling_box_top10", f"""
    SELECT calling_box_label, {big('sum(calling_box_count)')} AS calling_box_count,
           count(DISTINCT robot_code) AS robot_count, min(first_called_at) AS first_called_at,
           max(last_called_at) AS last_called_at
    FROM calling_box_hourly GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
oracle("label_trend_top6", f"""
    SELECT stat_hour, task_label, {big('sum(assigned_task_count)')} AS assigned_task_count,
           {big('sum(completed_task_count)')} AS completed_task_count
    FROM assigned_task_hourly WHERE task_label IN (
        SELECT task_label FROM assigned_task_hourly GROUP BY 1 ORDER BY sum(assigned_task_count) DESC, 1 LIMIT 6)
    GROUP BY 1, 2""")
oracle("calling_box_trend_top6", f"""
    SELECT time_bucket(INTERVAL '1 day', stat_hour) AS stat_hour, calling_box_label,
           {big('sum(calling_box_count)')} AS calling_box_count
    FROM calling_box_hourly WHERE calling_box_label IN (
        SELECT calling_box_label FROM calling_box_hourly GROUP BY 1 ORDER BY sum(calling_box_count) DESC, 1 LIMIT 6)
    GROUP BY 1, 2""")
LABELS = {
    "lab": """
        SELECT q.queue_id, q.event_time, q.queue_status, q.calling_box_id,
               CASE WHEN coalesce(calling_box_name, '') = '' THEN 'Calling Box #' || CAST(calling_box_id AS VARCHAR)
                    ELSE calling_box_name || ' · #' || CAST(calling_box_id AS VARCHAR) END AS calling_box_label,
               CASE WHEN coalesce(task_name, '') = '' THEN 'Task #' || q.job_id
                    ELSE task_name || ' · #' || q.job_id END AS task_label
        FROM queue_fact q JOIN robot_master m ON m.id = TRY_CAST(q.robot_id AS INTEGER)
        LEFT JOIN task_dim d ON d.job_id = TRY_CAST(q.job_id AS INTEGER)""",
}
oracle("label_trend_distinct", """
    SELECT time_bucket(INTERVAL '1 day', event_time) AS stat_hour, task_label,
           count(DISTINCT queue_id) AS assigned_task_count,
           count(DISTINCT queue_id) FILTER (lower(trim(queue_status)) IN ('completed', 'compleated'))
             AS completed_task_count
    FROM lab WHERE task_label IN (SELECT task_label FROM lab GROUP BY 1 ORDER BY count(DISTINCT queue_id) DESC, 1 LIMIT 6)
    GROUP BY 1, 2""", **LABELS)
oracle("calling_box_trend_distinct", """
    SELECT time_bucket(INTERVAL '1 day', event_time) AS stat_hour, calling_box_label,
           count(DISTINCT queue_id) AS calling_box_count
    FROM lab WHERE calling_box_id IS NOT NULL AND calling_box_label IN (
        SELECT calling_box_label FROM lab WHERE calling_box_id IS NOT NULL
        GROUP BY 1 ORDER BY count(DISTINCT queue_id) DESC, 1 LIMIT 6)
    GROUP BY 1, 2""", **LABELS)

# -- projects ----------------------------------------------------------------------

PROJECT = {
    "exe": f"""
        SELECT queue_id, {big("sum(CASE WHEN end_time IS NULL THEN 0 ELSE date_diff('second', start_time, end_time) END)")}
                 AS execution_seconds, count(*) AS subjob_run_count,
               count(*) FILTER (status = 'success') AS subjob_success_count, max(start_time) AS last_execution_time
        FROM task_run GROUP BY 1""",
    "sq": """
        SELECT q.queue_fact_id, q.queue_id, q.event_time, time_bucket(INTERVAL '1 day', q.event_time) AS bucket_start,
               TRY_CAST(q.project_id AS INTEGER) AS project_id, p.name AS project_name,
               TRY_CAST(q.job_id AS INTEGER) AS job_id, d.task_name, m.id AS robot_master_id, m.name AS robot_name,
               q.queue_status, q.calling_box_name, coalesce(exe.execution_seconds, 0) AS execution_seconds,
               coalesce(subjob_run_count, 0) AS subjob_run_count, coalesce(subjob_success_count, 0) AS subjob_success_count
        FROM queue_fact q LEFT JOIN project p ON p.id = TRY_CAST(q.project_id AS INTEGER)
        LEFT JOIN task_dim d ON d.job_id = TRY_CAST(q.job_id AS INTEGER)
        LEFT JOIN robot_master m ON m.id = TRY_CAST(q.robot_id AS INTEGER)
        LEFT JOIN exe ON exe.queue_id = TRY_CAST(q.queue_id AS BIGINT)""",
}
OUTCOME_COUNTS = """
    count(*) FILTER (queue_status = 'completed') AS completed_count,
    count(*) FILTER (queue_status IN ('failed', 'cancelled', 'canceled')) AS unsuccessful_count"""
OPEN_COUNT = "count(*) FILTER (queue_status IN ('in_progress', 'pending')) AS open_count"
EXECUTED = f"{big('sum(execution_seconds)')} AS execution_seconds"
AVERAGE = f"{ratio('sum(execution_seconds)', 'count(*) FILTER (execution_seconds > 0)', 6)} AS average_execution_seconds"
oracle("execution_per_queue", "SELECT * FROM exe", **PROJECT)
oracle("project_summary", f"""
    SELECT count(*) AS queue_count, count(DISTINCT project_id) AS project_count, count(DISTINCT job_id) AS task_count,
           count(DISTINCT robot_master_id) AS robot_count, {OUTCOME_COUNTS}, {OPEN_COUNT}, {EXECUTED},
           max(event_time) AS latest_event_time FROM sq""", **PROJECT)
oracle("project_list", f"""
    SELECT project_id, coalesce(project_name, 'Unmapped project') AS project_name, count(*) AS queue_count,
           count(DISTINCT job_id) AS task_count, count(DISTINCT robot_master_id) AS robot_count, {OUTCOME_COUNTS},
           {OPEN_COUNT}, {EXECUTED}, max(event_time) AS latest_event_time FROM sq GROUP BY 1, 2""", **PROJECT)
oracle("task_list", f"""
    SELECT project_id, coalesce(project_name, 'Unmapped project') AS project_name, job_id,
           coalesce(task_name, 'Job ' || CAST(job_id AS VARCHAR)) AS task_name, count(*) AS queue_count,
           count(DISTINCT robot_master_id) AS robot_count, {OUTCOME_COUNTS}, {OPEN_COUNT}, {EXECUTED},
           {big('sum(subjob_run_count)')} AS subjob_run_count, {AVERAGE}, max(event_time) AS latest_event_time
    FROM sq GROUP BY 1, 2, 3, 4""", **PROJECT)
oracle("robot_breakdown", f"""
    SELECT robot_master_id, coalesce(robot_name, 'Unmapped robot') AS robot_name, count(*) AS queue_count,
           count(DISTINCT job_id) AS task_count, {OUTCOME_COUNTS}, {OPEN_COUNT}, {EXECUTED}, {AVERAGE},
           max(event_time) AS latest_event_time FROM sq GROUP BY 1, 2""", **PROJECT)
oracle("completion_totals", f"""
    SELECT queue_count, completed_count, unsuccessful_count, execution_seconds,
           {percent('completed_count', 'completed_count + unsuccessful_count')} AS completion_rate_percent
    FROM (SELECT count(*) AS queue_count, {OUTCOME_COUNTS}, {EXECUTED} FROM sq)""", **PROJECT)
oracle("project_robot_scope", """
    SELECT robot_code AS robot_id, master_robot_id, severity FROM rated
    WHERE robot_code IN (SELECT robot_name FROM sq)""", **PROJECT, **DIAGNOSIS)
oracle("project_trend", f"""
    SELECT bucket_start AS stat_hour, coalesce(robot_name, 'Unmapped robot') AS robot_name, count(*) AS queue_count,
           {OUTCOME_COUNTS}, {EXECUTED} FROM sq GROUP BY 1, 2""", **PROJECT)
oracle("outcome_breakdown", """
    SELECT coalesce(queue_status, 'unknown') AS queue_status, count(*) AS queue_count,
           count(DISTINCT robot_master_id) AS robot_count, count(DISTINCT job_id) AS task_count,
           max(event_time) AS latest_event_time FROM sq GROUP BY 1""", **PROJECT)
oracle("recent_evidence", """
    SELECT queue_id, event_time, coalesce(project_name, 'Unmapped project') AS project_name,
           coalesce(task_name, 'Job ' || CAST(job_id AS VARCHAR)) AS task_name,
           coalesce(robot_name, 'Unmapped robot') AS robot_name, queue_status, calling_box_name, execution_seconds,
           subjob_run_count, subjob_success_count
    FROM sq""", **PROJECT)
oracle("idle_causes", f"""
    SELECT robot_code AS robot_name, {', '.join(f'{big(f"sum({name})")} AS {name}' for name in
           ('no_task_seconds', 'waiting_seconds', 'charging_seconds', 'executing_seconds'))}
    FROM task_hourly WHERE robot_code IN (SELECT robot_name FROM sq) GROUP BY 1""", **PROJECT)

# -- signal strength -----------------------------------------------------------------

RUNNING = {
    "bound": """
        SELECT least((SELECT max(pc_timestamp) FROM job_history), (SELECT max(pc_timestamp) FROM wifi_history)) AS a""",
    "jobs": """
        SELECT * FROM (
            SELECT j.*, s.robot_code,
                   row_number() OVER (PARTITION BY j.amr_id, j.pc_timestamp ORDER BY j.ods_row_id DESC) AS rn
            FROM job_history j JOIN scope s ON s.master_robot_id = j.amr_id
            WHERE job_status = 'Running' AND pc_timestamp >= (SELECT a - INTERVAL 720 HOUR FROM bound)
              AND pc_timestamp < (SELECT a + INTERVAL 1 MILLISECOND FROM bound)) WHERE rn = 1""",
    "levels": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY amr_id, pc_timestamp ORDER BY ods_row_id DESC) AS rn
            FROM wifi_history) WHERE rn = 1""",
    "smp": """
        SELECT j.amr_id, j.robot_code, j.pc_timestamp, trim(j.poi_target) AS poi_target, w.wifi_signal_level AS lv,
               date_trunc('hour', j.pc_timestamp) AS bucket_start
        FROM jobs j JOIN levels w ON w.amr_id = j.amr_id AND w.pc_timestamp = j.pc_timestamp
        WHERE trim(j.poi_target) <> ''""",
}
SIGNAL = f"""
    count(*) FILTER (lv < 0) AS valid_signal_sample_count, count(*) FILTER (lv = 0) AS zero_signal_sample_count,
    count(*) FILTER (lv <= -67) AS weak_signal_sample_count,
    {ratio('sum(lv) FILTER (lv < 0)', 'count(*) FILTER (lv < 0)')} AS average_valid_rssi,
    min(lv) FILTER (lv < 0) AS minimum_valid_rssi, max(lv) FILTER (lv < 0) AS maximum_valid_rssi"""
WEAK_RATE = f"{percent('count(*) FILTER (lv <= -67)', 'count(*) FILTER (lv < 0)')} AS weak_signal_rate"
SPAN = "min(pc_timestamp) AS first_sample_time, max(pc_timestamp) AS last_sample_time"
RUNNING |= {
    "bytarget": f"""
        SELECT poi_target, count(*) AS sample_count, count(DISTINCT amr_id) AS robot_count, {SIGNAL}, {WEAK_RATE},
               count(DISTINCT amr_id) FILTER (lv <= -67) AS weak_robot_count,
               {percent('count(*) FILTER (lv = 0)', 'count(*)')} AS zero_signal_rate, {SPAN} FROM smp GROUP BY 1""",
    "byrobot": f"""
        SELECT robot_code, count(*) AS sample_count, count(DISTINCT poi_target) AS target_count, {SIGNAL}, {WEAK_RATE},
               count(DISTINCT poi_target) FILTER (lv <= -67) AS weak_target_count, {SPAN} FROM smp GROUP BY 1""",
    "bypair": f"""
        SELECT robot_code, poi_target, count(*) AS sample_count, {SIGNAL}, {WEAK_RATE}, {SPAN} FROM smp GROUP BY 1, 2""",
    "ranked": """
        SELECT *, row_number() OVER (ORDER BY lv, pc_timestamp DESC, robot_code, poi_target) AS r0,
               row_number() OVER (PARTITION BY robot_code ORDER BY lv, pc_timestamp DESC, poi_target) AS r1,
               row_number() OVER (PARTITION BY poi_target ORDER BY lv, pc_timestamp DESC, robot_code) AS r2,
               row_number() OVER (PARTITION BY robot_code, poi_target ORDER BY lv, pc_timestamp DESC) AS r3
        FROM smp WHERE lv < 0""",
    "wit": """
        SELECT 'ALL' AS scope_type, CAST(NULL AS VARCHAR) AS scope_robot_code, CAST(NULL AS VARCHAR) AS scope_poi_target,
               robot_code AS minimum_robot_code, poi_target AS minimum_poi_target, pc_timestamp AS minimum_event_time,
               lv AS minimum_rssi FROM ranked WHERE r0 = 1
        UNION ALL SELECT 'ROBOT', robot_code, NULL, robot_code, poi_target, pc_timestamp, lv FROM ranked WHERE r1 = 1
        UNION ALL SELECT 'TARGET', NULL, poi_target, robot_code, poi_target, pc_timestamp, lv FROM ranked WHERE r2 = 1
        UNION ALL SELECT 'ROBOT_TARGET', robot_code, poi_target, robot_code, poi_target, pc_timestamp, lv
        FROM ranked WHERE r3 = 1""",
    "wline": """
        SELECT robot_code, poi_target, bucket_start, count(*) AS weak_signal_sample_count,
               min(pc_timestamp) AS first_weak_time, max(pc_timestamp) AS last_weak_time, min(lv) AS minimum_rssi,
               max(lv) AS maximum_rssi FROM smp WHERE lv <= -67 GROUP BY 1, 2, 3""",
    "weakdiag": """
        SELECT 'ROBOT' AS scope_type, robot_code AS scope_robot_code, CAST(NULL AS VARCHAR) AS scope_poi_target,
               CASE WHEN valid_signal_sample_count >= 10 AND minimum_valid_rssi <= -67
                         AND minimum_valid_rssi = maximum_valid_rssi THEN 'WIFI_WEAK_SIGNAL_FIXED_VALUE'
                    WHEN weak_target_count >= 2 AND weak_signal_sample_count >= 10
                      THEN 'WIFI_WEAK_SIGNAL_MULTI_TARGET_ROBOT_RISK'
                    ELSE 'WIFI_WEAK_SIGNAL_CAUSE_UNRESOLVED' END AS rule_id, weak_signal_sample_count, weak_signal_rate
        FROM byrobot WHERE weak_signal_sample_count > 0
        UNION ALL
        SELECT 'TARGET', NULL, poi_target, 'WIFI_WEAK_SIGNAL_MULTI_ROBOT_TARGET_RISK', weak_signal_sample_count,
               weak_signal_rate
        FROM bytarget WHERE weak_robot_count >= 2 AND weak_signal_sample_count >= 10""",
    "weakrated": """
        SELECT *, CASE rule_id WHEN 'WIFI_WEAK_SIGNAL_FIXED_VALUE' THEN 'HIGH'
                       WHEN 'WIFI_WEAK_SIGNAL_CAUSE_UNRESOLVED' THEN 'LOW' ELSE 'MEDIUM' END AS confidence,
               CASE rule_id WHEN 'WIFI_WEAK_SIGNAL_FIXED_VALUE' THEN 'DATA_QUALITY_RISK'
                    WHEN 'WIFI_WEAK_SIGNAL_MULTI_TARGET_ROBOT_RISK' THEN 'LIKELY_ROBOT_RISK'
                    WHEN 'WIFI_WEAK_SIGNAL_MULTI_ROBOT_TARGET_RISK' THEN 'LIKELY_POINT_RISK' ELSE 'UNRESOLVED' END
                 AS cause_status,
               CASE rule_id WHEN 'WIFI_WEAK_SIGNAL_FIXED_VALUE' THEN 3 WHEN 'WIFI_WEAK_SIGNAL_CAUSE_UNRESOLVED' THEN 1
                    ELSE 2 END AS priority FROM weakdiag""",
}
oracle("wifi_running_summary", f"""
    SELECT count(*) AS running_matched_sample_count, count(DISTINCT amr_id) AS robot_count,
           count(DISTINCT poi_target) AS target_count, {SIGNAL}, {WEAK_RATE}, {SPAN} FROM smp""", **RUNNING)
oracle("wifi_running_trend", f"""
    SELECT robot_code, poi_target, bucket_start, count(*) AS sample_count, count(DISTINCT amr_id) AS robot_count, {SIGNAL}
    FROM smp GROUP BY 1, 2, 3""", **RUNNING)
oracle("wifi_running_by_target", "SELECT * FROM bytarget", **RUNNING)
oracle("wifi_running_by_robot", "SELECT * FROM byrobot", **RUNNING)
oracle("wifi_running_by_robot_target", "SELECT * FROM bypair", **RUNNING)
oracle("wifi_minimum_witness", "SELECT * FROM wit", **RUNNING)
oracle("weak_timeline", "SELECT * FROM wline", **RUNNING)
oracle("weak_buckets", f"""
    SELECT bucket_start, {big('sum(weak_signal_sample_count)')} AS weak_signal_sample_count,
           min(first_weak_time) AS first_weak_time, max(last_weak_time) AS last_weak_time,
           min(minimum_rssi) AS minimum_rssi, max(maximum_rssi) AS maximum_rssi FROM wline GROUP BY 1""", **RUNNING)
oracle("weak_peak", f"""
    SELECT bucket_start, n AS weak_signal_sample_count, total AS total_weak_count,
           {percent('n', 'total')} AS peak_share_percent
    FROM (SELECT bucket_start, {big('sum(weak_signal_sample_count)')} AS n,
                 (SELECT {big('sum(weak_signal_sample_count)')} FROM wline) AS total FROM wline GROUP BY 1)
    ORDER BY n DESC, bucket_start LIMIT 1""", **RUNNING)
CENTI = "CAST(round(average_valid_rssi * 100) AS BIGINT)"
oracle("rssi_reaggregate", f"""
    SELECT poi_target, {big('sum(sample_count)')} AS sample_count,
           {big('sum(valid_signal_sample_count)')} AS valid_signal_sample_count,
           {big('sum(zero_signal_sample_count)')} AS zero_signal_sample_count,
           min(minimum_valid_rssi) AS minimum_valid_rssi, count(DISTINCT robot_code) AS robot_count,
           {ratio(f'sum({CENTI} * valid_signal_sample_count)', 'sum(valid_signal_sample_count) * 100', 6)}
             AS average_valid_rssi
    FROM bypair GROUP BY 1""", **RUNNING)
oracle("rssi_trend_reaggregate", f"""
    SELECT bucket_start, {big('sum(sample_count)')} AS sample_count,
           {big('sum(valid_signal_sample_count)')} AS valid_signal_sample_count,
           {big('sum(zero_signal_sample_count)')} AS zero_signal_sample_count,
           min(minimum_valid_rssi) AS minimum_valid_rssi, count(DISTINCT robot_code) AS robot_count,
           {ratio(f'sum({CENTI} * valid_signal_sample_count)', 'sum(valid_signal_sample_count) * 100', 6)}
             AS average_valid_rssi
    FROM (SELECT robot_code, poi_target, bucket_start, count(*) AS sample_count, {SIGNAL} FROM smp GROUP BY 1, 2, 3)
    GROUP BY 1""", **RUNNING)
oracle("point_comparison", f"""
    SELECT robot_code, {big('sum(sample_count)')} AS sample_count,
           {big('coalesce(sum(valid_signal_sample_count) FILTER (average_valid_rssi IS NOT NULL), 0)')}
             AS valid_signal_sample_count,
           {big('sum(zero_signal_sample_count)')} AS zero_signal_sample_count,
           min(minimum_valid_rssi) AS minimum_valid_rssi,
           {ratio(f'sum({CENTI} * sample_count)', '(sum(sample_count) FILTER (average_valid_rssi IS NOT NULL)) * 100', 6)}
             AS average_valid_rssi
    FROM bypair GROUP BY 1""", **RUNNING)
oracle("wifi_minimum_diagnosis", """
    SELECT scope_type, scope_type || '|' || coalesce(scope_robot_code, '') || '|' || coalesce(scope_poi_target, '')
             AS scope_key, minimum_robot_code AS robot_code, minimum_poi_target AS poi_target,
           minimum_event_time AS event_time, minimum_rssi, rule_id,
           CASE rule_id WHEN 'WIFI_RSSI_VALUE_STUCK' THEN 'HIGH' WHEN 'WIFI_MINIMUM_CAUSE_UNRESOLVED' THEN 'LOW'
                ELSE 'MEDIUM' END AS confidence,
           CASE rule_id WHEN 'WIFI_RSSI_VALUE_STUCK' THEN 'DATA_QUALITY_RISK'
                WHEN 'WIFI_POINT_COVERAGE_RISK' THEN 'LIKELY_POINT_RISK'
                WHEN 'WIFI_ROBOT_SIDE_RISK' THEN 'LIKELY_ROBOT_RISK' ELSE 'UNRESOLVED' END AS cause_status
    FROM (SELECT wit.*, CASE
              WHEN r.valid_signal_sample_count >= 10 AND r.minimum_valid_rssi = r.maximum_valid_rssi
                THEN 'WIFI_RSSI_VALUE_STUCK'
              WHEN t.valid_signal_sample_count >= 20 AND t.robot_count >= 2 AND t.average_valid_rssi <= -67
                THEN 'WIFI_POINT_COVERAGE_RISK'
              WHEN r.valid_signal_sample_count >= 20 AND r.target_count >= 2 AND r.average_valid_rssi <= -67
                THEN 'WIFI_ROBOT_SIDE_RISK' ELSE 'WIFI_MINIMUM_CAUSE_UNRESOLVED' END AS rule_id
          FROM wit LEFT JOIN byrobot r ON r.robot_code = minimum_robot_code
          LEFT JOIN bytarget t ON t.poi_target = minimum_poi_target)""", **RUNNING)
oracle("wifi_weak_diagnosis", "SELECT * FROM weakrated", **RUNNING)
oracle("primary_wifi_diagnostic", """
    SELECT scope_robot_code, rule_id, weak_signal_sample_count, weak_signal_rate FROM weakrated
    WHERE scope_type = 'ROBOT'
    ORDER BY CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, weak_signal_rate DESC,
             weak_signal_sample_count DESC, lower(scope_robot_code), scope_robot_code LIMIT 1""", **RUNNING)
oracle("profile_wifi_hourly", f"""
    SELECT date_trunc('hour', pc_timestamp) AS stat_hour, count(*) AS sample_count,
           min(wifi_signal_level) FILTER (wifi_signal_level < 0) AS min_rssi,
           max(wifi_signal_level) FILTER (wifi_signal_level < 0) AS max_rssi,
           count(*) FILTER (wifi_signal_level = 0) AS zero_signal_sample_count,
           count(*) FILTER (wifi_signal_level = 0 OR wifi_signal_level <= -70) AS weak_signal_sample_count,
           min(pc_timestamp) AS first_sample_time, max(pc_timestamp) AS last_sample_time,
           {ratio('sum(wifi_signal_level) FILTER (wifi_signal_level < 0)',
                  'count(*) FILTER (wifi_signal_level < 0)')} AS avg_rssi,
           {percent('count(*) FILTER (wifi_signal_level = 0)', 'count(*)')} AS zero_signal_rate
    FROM wifi_history GROUP BY 1""")

# -- intervals -------------------------------------------------------------------------

PAIRS = {
    "ex": """
        SELECT s.source_schema, s.source_table, s.source_ods_row_id, s.robot_code, s.event_time AS start_time,
               e.event_time AS end_time
        FROM operation_event s JOIN operation_event e
          ON e.source_schema = s.source_schema AND e.source_table = s.source_table
         AND e.source_ods_row_id = s.source_ods_row_id AND e.source_event_part = 'END'
        WHERE s.source_event_part = 'START' AND s.source_table = 'TA_AMR' AND e.event_time >= s.event_time""",
    "exo": """
        SELECT robot_code, start_time, end_time, source_ods_row_id,
               max(end_time) OVER (PARTITION BY robot_code ORDER BY start_time, end_time, source_ods_row_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM ex""",
    "exg": """
        SELECT *, sum(CASE WHEN prior IS NULL OR prior < start_time THEN 1 ELSE 0 END) OVER (
                     PARTITION BY robot_code ORDER BY start_time, end_time, source_ods_row_id ROWS UNBOUNDED PRECEDING)
                    AS grp FROM exo""",
}
INNER = ("TIMESTAMP '2024-01-01 07:02:30'", "TIMESTAMP '2024-01-30 17:01:10'")
SIX = ("TIMESTAMP '2024-01-30 17:02:00'", "TIMESTAMP '2024-01-30 23:01:00'")
MONTH = ("TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-02-01 00:00:00'")
oracle("pair_events", "SELECT * FROM ex", **PAIRS)
oracle("pair_events_clipped", f"""
    SELECT source_schema, source_table, source_ods_row_id, robot_code, greatest(start_time, {INNER[0]}) AS start_time,
           least(end_time, {INNER[1]}) AS end_time
    FROM ex WHERE start_time < {INNER[1]} AND end_time > {INNER[0]}""", **PAIRS)
oracle("merge_intervals", """
    SELECT robot_code, min(start_time) AS start_time, max(end_time) AS end_time FROM exg GROUP BY robot_code, grp""",
       **PAIRS)


def islands(extra_filter: str = "") -> dict[str, str]:
    return {
        "bsrc": f"""
            SELECT robot_code, sample_time, upper(trim(charging_status)) = 'CHARGING' AS is_charging
            FROM battery_fact WHERE trim(charging_status) <> '' {extra_filter}""",
        "bord": """
            SELECT *, lag(sample_time) OVER w AS pt, lag(is_charging) OVER w AS pc FROM bsrc
            WINDOW w AS (PARTITION BY robot_code ORDER BY sample_time)""",
        "bgrp": """
            SELECT *, sum(CASE WHEN pt IS NULL OR date_diff('second', pt, sample_time) > 43200 OR pc <> is_charging
                               THEN 1 ELSE 0 END)
                        OVER (PARTITION BY robot_code ORDER BY sample_time ROWS UNBOUNDED PRECEDING) AS grp FROM bord""",
        "bcol": """
            SELECT robot_code, grp, min(sample_time) AS start_time, max(sample_time) AS last_sample_time,
                   bool_or(is_charging) AS is_charging FROM bgrp GROUP BY 1, 2""",
        "bnext": """
            SELECT *, lead(start_time) OVER (PARTITION BY robot_code ORDER BY start_time) AS nx FROM bcol""",
        "isl": """
            SELECT robot_code, start_time,
                   CASE WHEN nx IS NOT NULL AND nx <= last_sample_time + INTERVAL 43200 SECOND THEN nx
                        ELSE last_sample_time END AS end_time, last_sample_time, is_charging FROM bnext""",
    }


oracle("state_islands", "SELECT * FROM isl", **islands())
WAITING = """
    SELECT s.robot_code, q.queue_id, q.queue_start_time AS start_time, min(s.event_time) AS end_time
    FROM event_queue q JOIN operation_event s ON s.queue_id = q.queue_id
    WHERE s.source_table = 'TA_AMR' AND s.source_event_part = 'START' AND s.event_time >= q.queue_start_time {more}
    GROUP BY 1, 2, 3"""
oracle("waiting_intervals", WAITING.format(more=""))


def merged(source: str) -> str:
    """Islands of the intervals (robot_code, s, e) of ``source``; ``i`` makes the order total."""
    return f"""
        SELECT robot_code, min(s) AS s, max(e) AS e FROM (
            SELECT *, sum(CASE WHEN prior IS NULL OR prior < s THEN 1 ELSE 0 END) OVER (
                         PARTITION BY robot_code ORDER BY s, e, i ROWS UNBOUNDED PRECEDING) AS grp
            FROM (SELECT *, max(e) OVER (PARTITION BY robot_code ORDER BY s, e, i
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM {source}))
        GROUP BY robot_code, grp"""


def timeline(window: tuple[str, str], minutes: int) -> dict[str, str]:
    """Cut points and range joins, the way the sweep is not done."""
    lo, hi = window
    step = f"INTERVAL '{minutes} minutes'"
    wait = WAITING.format(more=f"AND q.queue_start_time < {hi} AND s.event_time > {lo}")
    return {
        **PAIRS,
        **islands(f"AND sample_time >= {lo} - INTERVAL 43200 SECOND AND sample_time < {hi}"),
        "act": "SELECT robot_code FROM robot_dim WHERE is_enabled",
        "e1": f"""SELECT robot_code, greatest(start_time, {lo}) AS s, least(end_time, {hi}) AS e, source_ods_row_id AS i
                  FROM ex WHERE start_time < {hi} AND end_time > {lo}""",
        "e2": merged("e1"),
        "b2": f"SELECT robot_code, greatest(start_time, {lo}) AS s, end_time AS e, is_charging FROM isl WHERE end_time > {lo}",
        "w1": f"""SELECT robot_code, greatest(start_time, {lo}) AS s, least(end_time, {hi}) AS e, queue_id AS i
                  FROM ({wait})""",
        "w2": merged("w1"),
        "cuts": f"""
            SELECT robot_code, {lo} AS p FROM act UNION SELECT robot_code, {hi} FROM act
            UNION SELECT robot_code, unnest(generate_series(time_bucket({step}, {lo}, TIMESTAMP '2000-01-01') + {step},
                                                            {hi}, {step})) FROM act
            UNION SELECT robot_code, s FROM e2 UNION SELECT robot_code, e FROM e2
            UNION SELECT robot_code, s FROM b2 UNION SELECT robot_code, e FROM b2
            UNION SELECT robot_code, s FROM w2 UNION SELECT robot_code, e FROM w2""",
        "seg": f"""
            SELECT * FROM (
                SELECT robot_code, p AS s, lead(p) OVER (PARTITION BY robot_code ORDER BY p) AS e
                FROM cuts WHERE p >= {lo} AND p <= {hi} AND robot_code IN (SELECT robot_code FROM act))
            WHERE e IS NOT NULL AND e > s""",
        "flag": f"""
            SELECT seg.robot_code, seg.s, seg.e, time_bucket({step}, seg.s, TIMESTAMP '2000-01-01') AS bucket_start,
                   EXISTS (SELECT 1 FROM e2 WHERE e2.robot_code = seg.robot_code AND seg.s >= e2.s AND seg.s < e2.e)
                     AS executing,
                   EXISTS (SELECT 1 FROM b2 WHERE b2.robot_code = seg.robot_code AND b2.is_charging AND seg.s >= b2.s
                           AND seg.s < b2.e) AS charging,
                   EXISTS (SELECT 1 FROM w2 WHERE w2.robot_code = seg.robot_code AND seg.s >= w2.s AND seg.s < w2.e)
                     AS waiting,
                   EXISTS (SELECT 1 FROM b2 WHERE b2.robot_code = seg.robot_code AND seg.s >= b2.s AND seg.s < b2.e)
                     AS observed
            FROM seg""",
        "sec": """
            SELECT robot_code, bucket_start, date_diff('second', s, e) AS n,
                   CASE WHEN executing THEN 1 WHEN charging THEN 2 WHEN waiting THEN 3 WHEN observed THEN 4 ELSE 5 END AS st
            FROM flag""",
        "tot": f"""
            SELECT bucket_start, robot_code, {', '.join(
                f"{big(f'coalesce(sum(n) FILTER (st = {i}), 0)')} AS {name}" for i, name in enumerate(STATES, 1))}
            FROM sec GROUP BY 1, 2""",
        "cnt": f"""
            SELECT robot_code, time_bucket({step}, event_time, TIMESTAMP '2000-01-01') AS bucket_start,
                   count(*) FILTER (event_type = 'QUEUE_ENQUEUED') AS accepted_queue_count,
                   count(*) FILTER (event_type = 'JOB_STARTED') AS task_started_count,
                   count(*) FILTER (event_type = 'SUBJOB_STARTED') AS subtask_started_count,
                   count(*) FILTER (event_type = 'JOB_ENDED' AND lower(trim(coalesce(event_status, ''))) = 'success')
                     AS task_completed_count
            FROM operation_event WHERE event_time >= {lo} AND event_time < {hi} GROUP BY 1, 2""",
    }


TREND = f"""
    SELECT tot.bucket_start AS stat_hour, tot.robot_code, {', '.join(STATES)},
           {', '.join(f'coalesce({name}, 0) AS {name}' for name in COUNTS)}
    FROM tot LEFT JOIN cnt ON cnt.robot_code = tot.robot_code AND cnt.bucket_start = tot.bucket_start"""
oracle("state_trend_5min", TREND, **timeline(SIX, 5))
oracle("state_trend_15min", TREND, **timeline(MONTH, 15))
oracle("state_trend_hour", TREND, **timeline(MONTH, 60))
oracle("state_trend_day", TREND, **timeline(MONTH, 1440))
THREE_DAYS = ("TIMESTAMP '2024-01-20 05:00:00'", "TIMESTAMP '2024-01-23 05:00:00'")
oracle("stored_intervals", f"""
    SELECT 'executing' AS kind, CAST(source_ods_row_id AS VARCHAR) AS id, robot_code, greatest(start_time, {THREE_DAYS[0]}) AS start_time,
           least(end_time, {THREE_DAYS[1]}) AS end_time
    FROM ex WHERE start_time < {THREE_DAYS[1]} AND end_time > {THREE_DAYS[0]}
    UNION ALL
    SELECT DISTINCT 'waiting', queue_id, robot_code, greatest(start_time, {THREE_DAYS[0]}), least(end_time, {THREE_DAYS[1]})
    FROM ({WAITING.format(more=f"AND q.queue_start_time < {THREE_DAYS[1]} AND s.event_time > {THREE_DAYS[0]}")})""", **PAIRS)
oracle("state_runs", """
    SELECT robot_code, min(s) AS start_time, max(e) AS end_time, min(state) AS state FROM (
        SELECT *, sum(opens) OVER (PARTITION BY robot_code ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY robot_code ORDER BY s) THEN 1 ELSE 0 END AS opens
            FROM (SELECT robot_code, s, e, CASE WHEN executing THEN 'executing' WHEN charging THEN 'charging' WHEN waiting THEN 'waiting'
                                                WHEN observed THEN 'no_task' ELSE 'data_unavailable' END AS state FROM flag)))
    GROUP BY robot_code, run""", **timeline(MONTH, 1440))
oracle("atomic_segments", """
    SELECT robot_code, bucket_start, s AS start_time, e AS end_time, executing, charging, waiting, observed FROM flag""",
       **timeline(INNER, 60))

# -- rules over states derived from every event ---------------------------------

STATES = {
    "varied": "SELECT event_id AS i, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, event_id % 19 = 0 AS stopped, event_id % 23 = 0 AS unmetered FROM events",
    "sv": """
        SELECT i, i % 3 = 0 AS off,
               CASE WHEN stopped OR i % 13 > 3 THEN 'CURRENT'
                    ELSE ['DWS_REFRESH_TIMEOUT', 'DWS_SOURCE_LAG', 'SOURCE_TIMEOUT', 'MISSING'][i % 13 + 1] END AS gate,
               CASE WHEN stopped THEN 200 WHEN unmetered THEN 0 ELSE i % 5 * 30 END AS st_age, CASE WHEN stopped THEN 201 ELSE i % 4 * 25 END AS wi_age,
               CASE WHEN stopped THEN 200 ELSE i % 6 * 20 END AS ba_age, stopped,
               CASE WHEN stopped THEN -60 WHEN NOT unmetered THEN [0, -60, -80, NULL, NULL][i % 5 + 1] END AS lvl,
               50 + i % 3 * 60 AS n, i % 2 = 0 AS even, i % 7 = 0 OR i % 2 = 0 AS associated, i % 7 <> 1 AS wi_current,
               (k * 7 + i) % 101 <= 20 AS low, i % 4 = 0 AS charging, i % 17 = 0 AS err
        FROM varied""",
    "judged": """
        SELECT *, off OR st_age > 60 AS gone, wi_age <= 60 AND lvl = 0 AS w0, wi_age <= 60 AND lvl < 0 AS wok,
               lvl IS NULL AND associated AND n >= 100 AND even AS unmeasured
        FROM sv""",
    "ruled": """
        SELECT *, CASE WHEN gate = 'DWS_REFRESH_TIMEOUT' THEN 'DWS_REFRESH_TIMEOUT' WHEN gate = 'DWS_SOURCE_LAG' THEN 'DWS_SOURCE_LAG'
            WHEN gate = 'SOURCE_TIMEOUT' THEN 'DWS_SOURCE_TIMEOUT' WHEN gate = 'MISSING' THEN 'DWS_STATUS_MISSING'
            WHEN gone AND coalesce(w0, false) THEN 'DISCONNECT_WIFI_ZERO'
            WHEN gone AND low AND ba_age <= 60 AND NOT charging THEN 'DISCONNECT_LOW_BATTERY'
            WHEN gone AND coalesce(wok, false) THEN 'DISCONNECT_WIFI_HEALTHY_STATUS_STALE'
            WHEN gone AND stopped THEN 'SOURCE_TELEMETRY_ALL_TOPICS_STOPPED'
            WHEN gone THEN 'DISCONNECT_EVIDENCE_STALE' WHEN err THEN 'DEVICE_ERROR_EXPLICIT' WHEN low THEN 'LOW_BATTERY_CURRENT'
            WHEN unmeasured AND wi_age <= 60 THEN 'WIFI_RSSI_MEASUREMENT_UNAVAILABLE' END AS rule_id
        FROM judged""",
}
oracle("robot_diagnosis_every_rule", """
    SELECT 'R' || i AS robot_id, rule_id,
           CASE WHEN rule_id = 'DISCONNECT_EVIDENCE_STALE' THEN 'LOW'
                WHEN rule_id IN ('DWS_SOURCE_TIMEOUT', 'DISCONNECT_WIFI_HEALTHY_STATUS_STALE', 'SOURCE_TELEMETRY_ALL_TOPICS_STOPPED')
                  OR rule_id = 'DISCONNECT_LOW_BATTERY' AND coalesce(wok, false) OR rule_id = 'LOW_BATTERY_CURRENT' AND ba_age > 60
                  THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
           CASE WHEN rule_id IN ('DWS_REFRESH_TIMEOUT', 'DISCONNECT_WIFI_ZERO', 'DISCONNECT_LOW_BATTERY', 'DEVICE_ERROR_EXPLICIT')
                  THEN 'CRITICAL' WHEN rule_id = 'LOW_BATTERY_CURRENT' AND charging THEN 'WATCH' ELSE 'WARNING' END AS severity
    FROM ruled WHERE rule_id IS NOT NULL""", **STATES)
oracle("alert_causes_every_kind", """
    SELECT 'R' || i AS robot_id, gate AS code, 'data-stale' AS type FROM judged WHERE gate <> 'CURRENT'
    UNION ALL SELECT 'R' || i, 'E7', 'device-error' FROM judged WHERE err
    UNION ALL SELECT 'R' || i, 'LOW_BATTERY', 'low-battery' FROM judged WHERE low
    UNION ALL SELECT 'R' || i, 'NO_SIGNAL', 'no-signal' FROM judged WHERE lvl = 0 AND (off OR st_age > 60)
    UNION ALL SELECT 'R' || i, 'RSSI_MEASUREMENT_UNAVAILABLE', 'data-quality' FROM judged WHERE wi_current AND unmeasured""", **STATES)
oracle("fleet_assessment_every_rule", BODIES["fleet_assessment"].replace("FROM rated", "FROM stated"), **ASSESSMENT, **STATES, stated=BODIES["robot_diagnosis_every_rule"])
VARIED = {
    "robot": """
        SELECT event_id AS i, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, event_id % 5 <> 0 AND event_id % 7 <> 0 AS seen,
               event_id % 4 = 0 AS charging, event_id % 17 = 0 AS err, ['AMR', 'AMB', 'OTHER'][event_id % 3 + 1] AS robot_type
        FROM events""",
    "load": """
        SELECT *, CAST(CASE WHEN robot_type = 'AMR' THEN CASE WHEN i % 2 = 0 THEN 0 ELSE 10 + k END WHEN i = 1 THEN 1000000000
                            WHEN robot_type = 'AMB' THEN i % 2 ELSE 0 END AS BIGINT) AS n FROM robot""",
    "kinds": "SELECT robot_type, sum(n) AS total, max(n) AS most, count(*) AS robots FROM load GROUP BY 1",
}
oracle("workload_every_class", """
    SELECT 'R' || i AS robot_id, robot_type, n AS assigned_task_count,
           CASE WHEN total = 0 THEN 'NO_DATA' WHEN n = 0 AND NOT seen THEN 'TELEMETRY_UNAVAILABLE'
                WHEN n = 0 AND charging THEN 'CURRENTLY_CHARGING_NO_TASK' WHEN n = 0 AND err THEN 'CURRENT_ERROR_NO_TASK'
                WHEN n = 0 THEN 'OBSERVED_IDLE_OR_INELIGIBLE'
                WHEN 100 * most >= 60 * total AND robots >= 3 AND n = most THEN 'CONCENTRATED' ELSE 'BALANCED' END AS classification
    FROM load JOIN kinds USING (robot_type)""", **VARIED)
oracle("exception_every_type", """
    SELECT event_id, CASE WHEN event_id % 2 <> 0 THEN 'PARTIAL_STATE_COVERAGE_GAP' WHEN event_id % 3 <> 0 THEN 'FULL_STATE_COVERAGE_GAP_UNRESOLVED'
                          WHEN event_id % 5 = 0 THEN 'FULL_NO_BATTERY_OR_TASK_EVIDENCE' ELSE 'FULL_TASK_EVENT_WITHOUT_BATTERY_EVIDENCE' END
               AS exception_type FROM events""")
oracle("asof_before_null_keys", """
    SELECT event_id, key, ts, seen AS prior FROM (
        SELECT l.event_id, l.key, l.ts, r.seen, row_number() OVER (PARTITION BY l.event_id ORDER BY r.seen_at DESC NULLS LAST) AS n
        FROM l LEFT JOIN r ON r.key = l.key AND r.seen_at < l.ts) WHERE n = 1""",
       l="""
        SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(user_id AS INTEGER) END AS key, ts FROM events WHERE event_type = 'purchase'""",
       r="""
        SELECT CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS INTEGER) END AS key, ts AS seen_at,
               CASE WHEN event_id % 3 <> 0 THEN event_id END AS seen FROM events WHERE event_type <> 'purchase'""")

# -- results of whole reports ----------------------------------------------------

oracle("dashboard_diagnostics", "SELECT master_robot_id, rule_id, confidence, severity FROM rated", **DIAGNOSIS)
oracle("profile_job_days", """
    SELECT stat_date, CAST(sum(job_count) AS BIGINT) AS job_count, CAST(sum(distinct_job_count) AS BIGINT) AS distinct_job_count,
           CAST(sum(completed_status_count) AS BIGINT) AS completed_status_count,
           CAST(sum(failed_status_count) AS BIGINT) AS failed_status_count,
           min(first_job_start_time) AS first_job_start_time, max(last_job_start_time) AS last_job_start_time
    FROM job_daily WHERE robot_code = '7' AND stat_date >= (SELECT max(stat_date) FROM job_daily) - INTERVAL 89 DAY GROUP BY 1""")
oracle("usage_minutes_per_robot", """
    SELECT time_bucket(INTERVAL '1 day', stat_hour) AS stat_hour, robot_code AS series,
           CAST(sum(executing_seconds) AS DOUBLE) / 60 AS executing_minutes
    FROM task_hourly GROUP BY 1, 2""")
oracle("daily_totals_as_is", f"""
    SELECT stat_date, {', '.join(f'{big(f"sum({name})")} AS {name}' for name in
    ('job_count', 'distinct_job_count', 'completed_status_count', 'failed_status_count'))}
    FROM job_daily GROUP BY 1""")
oracle("recent_tasks", "SELECT id, amr_id, start_time, end_time FROM task_run ORDER BY id DESC LIMIT 20")

# Results of the project report: the statements of its operators over the window and the chosen projects.
REPORT_DAYS = ("TIMESTAMP '1997-03-01 00:00:00'", "TIMESTAMP '1997-05-15 00:00:00'")
REPORT_ALL = {
    "exe": PROJECT["exe"].replace("FROM task_run", f"FROM task_run WHERE start_time >= {REPORT_DAYS[0]} AND start_time < {REPORT_DAYS[1]}"),
    "sq": PROJECT["sq"] + f" WHERE q.event_time >= {REPORT_DAYS[0]} AND q.event_time < {REPORT_DAYS[1]}",
}
REPORT_CHOSEN = {"exe": REPORT_ALL["exe"], "every": REPORT_ALL["sq"], "sq": "SELECT * FROM every WHERE project_id IN (1, 2, 3)"}
oracle("project_report_projects", BODIES["project_list"], **REPORT_ALL)
for result, body in (
    ("tasks", "task_list"), ("robots", "robot_breakdown"), ("trend", "project_trend"), ("outcomes", "outcome_breakdown"),
    ("recent", "recent_evidence"), ("displayed_totals", "completion_totals"),
):
    oracle(f"project_report_{result}", BODIES[body], **REPORT_CHOSEN)
oracle("project_report_export", f"""
    SELECT project_name AS "Project", task_name AS "Task", queue_count AS "Task_Records", 'ALL' AS "Selected_Jobs", '1,2,3' AS "Selected_Projects",
           execution_seconds AS "Execution_Seconds", latest_event_time AS "Latest_Record", {REPORT_DAYS[0]} AS "Analysis_Start",
           {REPORT_DAYS[1]} AS "Analysis_End" FROM ({BODIES["task_list"]})""", **REPORT_CHOSEN)

# Results of the task report over whole days of the hourly rollup.
IN_REPORT = "stat_hour >= TIMESTAMP '2024-01-05 00:00:00' AND stat_hour < TIMESTAMP '2024-01-25 00:00:00'"
oracle("task_report_state_trend", f"""
    SELECT time_bucket(INTERVAL '1 day', stat_hour) AS stat_hour, robot_code, {SUMS} FROM task_hourly WHERE {IN_REPORT} GROUP BY 1, 2""")
oracle("task_report_usage", f"""
    SELECT time_bucket(INTERVAL '1 day', stat_hour) AS stat_hour, robot_code AS series,
           CAST(sum(executing_seconds) AS DOUBLE) / 60 AS executing_minutes
    FROM task_hourly WHERE {IN_REPORT} AND robot_code IN ('3', '5', '8') GROUP BY 1, 2""")
oracle("task_report_coverage", BODIES["state_coverage_quality"], summ=SUMMARY["summ"].replace("FROM task_hourly", f"FROM task_hourly WHERE {IN_REPORT}").replace(
    "FROM assigned_task_hourly", f"FROM assigned_task_hourly WHERE {IN_REPORT}"))
oracle("profile_status_hours", """
    SELECT stat_hour, sample_count, online_sample_count, error_sample_count, first_status_time, last_status_time FROM status_hourly
    WHERE robot_code = '7' AND stat_hour >= (SELECT max(stat_hour) FROM status_hourly) - INTERVAL 719 HOUR""")
