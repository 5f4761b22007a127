"""Word lists, thresholds and labels that decide results."""

# --- robot identity -------------------------------------------------------
ROBOT_TYPES = ("AMR", "AMB")
OTHER_ROBOT_TYPE = "OTHER"
ALL_ROBOT_TYPES = "ALL"
ACTIVE_FLAG = "Y"
UNSET_SERIALS = ("", "UNDEFINED", "NULL")

# --- rollup rows ----------------------------------------------------------
ROLLUP_MARK = "__ALL__"
ROLLUP_TASK_LABEL = "ALL TASK OUTCOMES"
ROLLUP_MODE_LABEL = "ALL MODES"
ROLLUP_DETAIL_LABEL = "Queue outcomes across all task types"
NOT_REPORTED_CODE = "NOT_REPORTED"
NOT_REPORTED_TEXT = "Not reported"

# --- queue outcomes -------------------------------------------------------
COMPLETED_WORDS = (
    "COMPLETED", "COMPLEATED", "COMPLETE", "SUCCESS", "SUCCEEDED", "DONE", "FINISHED", "完成", "成功",
)
FAILURE_WORDS = {
    1: ("ABORTED",),
    2: ("ERROR", "异常"),
    3: ("FAILED", "FAIL", "失败"),
    4: ("CANCELLED", "CANCELED", "取消"),
}
FAILURE_NAMES = {1: "ABORTED", 2: "ERROR", 3: "FAILED", 4: "CANCELLED"}
NO_FAILURE_RANK = 99
UNKNOWN_OUTCOME = "UNKNOWN"
TREND_COMPLETED_WORDS = ("completed", "compleated")
PROJECT_COMPLETED = ("completed",)
PROJECT_UNSUCCESSFUL = ("failed", "cancelled", "canceled")
PROJECT_OPEN = ("in_progress", "pending")
SUBJOB_SUCCESS = "success"
JOB_END_SUCCESS = "success"
RUNNING_JOB_STATUS = "Running"

# --- operation events -----------------------------------------------------
EVENT_SOURCE_SCHEMA = "ODS"
EXECUTION_SOURCE_TABLE = "TA_AMR"
EVENT_START = "START"
EVENT_END = "END"
EVENT_TYPE_COUNTS = {
    "accepted_queue_count": "QUEUE_ENQUEUED",
    "task_started_count": "JOB_STARTED",
    "subtask_started_count": "SUBJOB_STARTED",
    "task_completed_count": "JOB_ENDED",
}
CHARGING_WORD = "CHARGING"

# --- fallback labels ------------------------------------------------------
UNMAPPED_PROJECT = "Unmapped project"
UNMAPPED_ROBOT = "Unmapped robot"
JOB_LABEL_PREFIX = "Job "
UNKNOWN_STATUS = "unknown"
CALLING_BOX_PREFIX = "Calling Box #"
TASK_PREFIX = "Task #"
LABEL_SEPARATOR = " · #"
MODE_PLACEHOLDER = "Not provided by DWS hourly data"
CURRENT_SOURCE_NAME = "DWS_NON_SNAPSHOT"
NO_MAP_CODE = "__NO_MAP__"
NO_MAP_LABEL = "Unassigned map"

# --- freshness ------------------------------------------------------------
MISSING = "MISSING"
REFRESH_TIMEOUT = "DWS_REFRESH_TIMEOUT"
SOURCE_LAG = "DWS_SOURCE_LAG"
SOURCE_TIMEOUT = "SOURCE_TIMEOUT"
CURRENT = "CURRENT"
TIMED_OUT_STATES = (REFRESH_TIMEOUT, SOURCE_LAG, SOURCE_TIMEOUT)
FRESHNESS_LABELS = {
    CURRENT: "DWS Data Current",
    REFRESH_TIMEOUT: "DWS Refresh Timeout",
    SOURCE_LAG: "DWS Source Lag",
    SOURCE_TIMEOUT: "Source Data Timeout",
}
FRESHNESS_MISSING_LABEL = "DWS Data Missing"
DEFAULT_FRESHNESS_MINUTES = 30
FRESHNESS_MINUTES_RANGE = (1, 1440)

# --- device predicates ----------------------------------------------------
ERROR_CODE_NOISE = ("", "-", "0", "1", "NULL", "UNDEFINED", "NONE", "FALSE", "TRUE", "OK", "NORMAL")
ERROR_MESSAGE_NOISE = ("", "-", "NULL", "UNDEFINED", "NONE")
CHARGING_WORDS = ("C", "CHARGING", "TRUE", "1", "ON")
CHARGING_MODE_PART = "CHARGE"
ONLINE_WORDS = ("ONLINE", "ON", "TRUE", "1", "ACTIVE")
OFFLINE_WORDS = ("OFFLINE", "OFF", "FALSE", "0", "INACTIVE")
IDLE_JOB_WORDS = ("", "-", "0", "NULL", "UNDEFINED", "IDLE")

# --- thresholds -----------------------------------------------------------
LOW_BATTERY_RANGE = (0, 20)
SOC_RANGE = (0, 100)
WEAK_RSSI = -67
PROFILE_WEAK_RSSI = -70
BATTERY_MAX_GAP_SECONDS = 300
BATTERY_SHARE_LEVEL = 60
LONG_TASK_SECONDS = 3600
LONG_QUEUE_SECONDS = 300
RELIABLE_COVERAGE_PERCENT = 80
ON_TIME_TARGET_PERCENT = 90
CONCENTRATION_SHARE_PERCENT = 60
CONCENTRATION_MIN_ROBOTS = 3
MIN_BATTERY_FRESH_MINUTES = 15
STREAM_STOP_SPREAD_MINUTES = 2
RSSI_MIN_SAMPLES = 100
RSSI_UNUSABLE_PERCENT = 95
LOADING_PATTERN = "(?i)(LOAD|UNLOAD|PICK|DROP|上料|下料|取料|放料)"

# --- ranks ----------------------------------------------------------------
SEVERITY_RANK = {"CRITICAL": 4, "WARNING": 3, "WATCH": 2, "HEALTHY": 1, "INFO": 0}
CONFIDENCE_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
WITNESS_SCOPE_RANK = {"ALL": 1, "ROBOT": 2, "TARGET": 3, "ROBOT_TARGET": 4}

# --- rule versions --------------------------------------------------------
RULE_VERSION = "2026.07.7"
MINIMUM_RULE_VERSION = "2026.07.30"
WEAK_RULE_VERSION = "2026.08.03"

# --- dispatch audit contract ---------------------------------------------
DISPATCH_AUDIT_FIELDS = (
    "decision_id", "task_id", "robot_id", "eligibility_result", "total_score", "selected_flag",
    "rejection_reason_code",
)
SCHEMA_KEYWORDS = (
    "dispatch", "candidate", "score", "reject", "eligible", "capability", "distance", "mileage",
)
