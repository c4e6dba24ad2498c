"""Fixed vocabulary and schemas of the event and edge tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# These must not change: stored hashes, projections and reports depend on them.

SLOTS = (
    "logon_id",
    "subject_logon_id",
    "process_id",
    "new_process_id",
    "parent_process_id",
    "process_name",
    "target_user",
    "subject_user",
    "ip_address",
    "service_name",
)

# slot -> (class, source field names in priority order)
SLOT_RECIPE = {
    "logon_id": ("identifier", ("TargetLogonId", "SubjectLogonId", "LogonId", "TargetLogonID")),
    "subject_logon_id": ("identifier", ("SubjectLogonId", "SubjectLogonID")),
    "process_id": ("identifier", ("ProcessId", "ProcessID", "ClientProcessId", "SourceProcessId")),
    "new_process_id": ("identifier", ("NewProcessId", "NewProcessID")),
    "parent_process_id": ("identifier", ("ParentProcessId", "CreatorProcessId", "ParentProcessID")),
    "process_name": ("image", ("NewProcessName", "Image", "ProcessName", "Application")),
    "target_user": ("plain", ("TargetUserName", "AccountName", "MemberName")),
    "subject_user": ("plain", ("SubjectUserName",)),
    "ip_address": ("plain", ("IpAddress", "ClientAddress", "SourceNetworkAddress", "SourceIp")),
    "service_name": ("plain", ("ServiceName", "ServiceFileName")),
}

SLOT_VERSION = 2
ABSENT_VALUES = ("-", "s-1-0-0", "null", "n/a", "(null)")

# Characters Unicode calls white space; used for every trim.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

FIELD_SEPARATOR = "\x1f"

REQUIRED_COLUMNS = ("event_id", "timestamp", "provider", "channel", "computer")
OPTIONAL_COLUMNS = ("user", "raw_xml")
COLUMN_ALIASES = {
    "event_id": ("eventid", "event_identifier", "eventidentifier"),
    "timestamp": ("time_created", "timecreated", "system_time", "systemtime", "event_time", "utc_time"),
    "provider": ("provider_name", "providername", "source_name", "sourcename", "source"),
    "channel": ("log_name", "logname", "channel_name"),
    "computer": ("computer_name", "computername", "hostname", "host", "machine"),
    "user": ("user_id", "userid", "security_user_id", "username", "user_name", "sid"),
    "raw_xml": ("xml", "raw_event", "event_xml", "eventxml", "raw", "message"),
}
MESSAGE_ALIASES = {
    "event_id": ("eventid", "event", "eid"),
    "provider_id": ("providerid", "provider", "source_id", "sourceid"),
    "message": ("text", "description", "template", "msg"),
}
PROVIDER_ALIASES = {
    "id": ("provider_id", "providerid"),
    "name": ("provider_name", "providername", "provider", "source_name"),
}
MILLIS_THRESHOLD = 100_000_000_000

RELATION_TYPES = ("temporal", "correlation", "default")
RELATION_VERSION = 1
CONFIDENCE_EXACT = 1.0
CONFIDENCE_ANCESTOR = 0.9

LINEAGE_CREATE_ID = "4688"
LINEAGE_EXIT_ID = "4689"

DEFAULT_BUCKETS = 240
MAX_LANES = 12
LANE_NONE = "(none)"
LANE_OTHER = "(other)"
HEATMAP_GROUPS = ("rule", "relation_type", "computer", "created_by", "step")

NO_RULE_LABEL = "Not from a rule"
ABSENT_SLOT_LABEL = "Not recorded"

SEVERITIES = ("error", "warning", "info")
# --- end of fixed values ----------------------------------------------------

EDGE_SCHEMA = T.StructType(
    [
        T.StructField("edge_id", T.StringType()),
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("graph_id", T.LongType()),
        T.StructField("relation_type", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("match_id", T.StringType()),
        T.StructField("step_index", T.IntegerType()),
        T.StructField("basis", T.ArrayType(T.StringType())),
        T.StructField("rel_version", T.IntegerType()),
    ]
)
EDGE_COLUMNS = tuple(f.name for f in EDGE_SCHEMA)
