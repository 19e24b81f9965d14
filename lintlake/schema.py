"""Row types of the tables the package reads and writes."""

FILES = (
    "file_path string, relative_path string, route_language string, size_bytes bigint, "
    "last_modified timestamp, content string"
)
VIOLATION_STRUCT = (
    "struct<file_path:string,line_number:int,line_content:string,violation_type:string,"
    "severity:string,platform:string,language:string,description:string,"
    "context_before:array<string>,context_after:array<string>,confidence_score:double,"
    "created_at:timestamp>"
)
STATS_STRUCT = (
    "struct<total_files_scanned:bigint,total_violations:bigint,"
    "violations_by_type:map<string,bigint>,violations_by_severity:map<string,bigint>,"
    "violations_by_platform:map<string,bigint>,violations_by_language:map<string,bigint>,"
    "scan_duration_seconds:double>"
)
SCAN_RESULT = (
    f"timestamp timestamp, repo_path string, violations array<{VIOLATION_STRUCT}>, "
    f"stats {STATS_STRUCT}"
)
MANIFEST_ITEM = (
    "struct<violation_id:string,file:string,violation_type:string,database_platform:string,"
    "language:string,line_range:string,code_snippet:string,severity:string,banking_context:string>"
)
MANIFEST = (
    f"manifest_version string, description string, total_violations bigint, "
    f"files_with_violations bigint, clean_files bigint, violations array<{MANIFEST_ITEM}>, "
    "violation_type_summary map<string,bigint>, severity_summary map<string,bigint>, "
    "platform_summary map<string,bigint>"
)
REPLIES = "violation_id string, kind string, content string, error string"
