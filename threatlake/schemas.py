"""Shared schemas: one wide nullable event, findings, assessments, signals and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def columns(text: str) -> T.StructType:
    """``name type`` pairs as a schema; needs no running session, unlike the DDL parser."""
    out = T.StructType()
    for item in text.replace("map<string,string>", "map<string;string>").split(","):
        name, kind = item.split()
        out.add(name, _TYPES[kind.replace(";", ",")])
    return out


FILE_METADATA = columns(
    "path string, sha256 string, size_bytes bigint, is_writable_location boolean, zone_id int"
)
SIGNATURE = columns("status string, signer string, message string, is_valid boolean")

EVENT_SCHEMA = columns(
    """
    seq bigint, host string, event_type string, ts timestamp,
    pid bigint, process_name string, executable string, create_time double, parent_pid bigint,
    parent_name string, command_line string, username string, status string, reasons array<string>,
    protocol string, local_ip string, local_port int, remote_ip string, remote_port int,
    is_public_ip boolean, country string, country_code string, region string, city string,
    org string, isp string, asn string, is_hosting boolean, hosting_provider string,
    threat_flagged boolean, threat_details string, is_suspicious_client boolean,
    connection_count bigint, is_repeated_burst boolean, is_wide_fanout boolean, is_foreign boolean,
    domain string, resolved_ips array<string>, ttls array<int>, entropy double,
    is_dynamic_dns boolean, is_suspicious_tld boolean, is_potential_dga boolean, indicators array<string>,
    file_path string, filename string, extension string, sha256 string, download_url string,
    referrer_url string, mark_of_the_web boolean, zone_id int, size_bytes bigint,
    item_id string, name string, command string, location string, location_type string, scope string,
    previous_command string, task_name string, task_to_run string, author string, run_as_user string,
    next_run_time string, last_run_time string, previous_task_to_run string,
    display_name string, binpath string, start_type string, description string, service_name string,
    previous_binpath string, previous_status string, previous_start_type string,
    extra map<string,string>
    """
).add("file_metadata", FILE_METADATA).add("signature", SIGNATURE)

FINDING_DDL = (
    "struct<rule_id:string,title:string,severity:string,confidence:string,"
    "evidence:map<string,string>,reason:string,explanation:string>"
)
FINDINGS_DDL = f"array<{FINDING_DDL}>"
RULES_DDL = "array<struct<rule_id:string,severity:string>>"
SIGNAL_DDL = "struct<id:string,weight:int,reason:string,evidence:string>"
SIGNALS_DDL = f"array<{SIGNAL_DDL}>"

PROCESS_TYPES = ["process_started", "process_observed", "process_terminated"]
AUTORUN_TYPES = ["startup_item_added", "startup_item_modified", "startup_item_removed"]
TASK_TYPES = ["scheduled_task_created", "scheduled_task_modified", "scheduled_task_deleted"]
SERVICE_TYPES = ["service_installed", "service_modified", "service_removed"]
PERSISTENCE_TYPES = AUTORUN_TYPES + TASK_TYPES + SERVICE_TYPES
NETWORK_TYPE = "network_connection_observed"
DNS_TYPE = "dns_query_observed"
DOWNLOAD_TYPE = "file_download_observed"


def conform_events(df: DataFrame) -> DataFrame:
    """Add the missing event columns as typed nulls; columns beyond the schema pass through."""
    present = {c.lower() for c in df.columns}
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in EVENT_SCHEMA.fields if f.name.lower() not in present
    }
    return df.withColumns(missing) if missing else df
