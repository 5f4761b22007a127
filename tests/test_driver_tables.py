from fleetlens.sources.driver_tables import DriverTables


def test_names_are_attached_to_orders_not_to_their_lines(spark, data_dir):
    attempts = DriverTables(spark, data_dir)["queue_attempts"]
    plan = attempts._jdf.queryExecution().optimizedPlan().toString()
    outer = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "l_orderkey" in outer and attempts.count() == DriverTables(spark, data_dir)["task_run"].count()
    assert attempts.columns == ["queue_id", "event_time", "queue_status", "robot_id", "robot_code"]
