"""Fixed table layouts and vocabularies."""

MANIFEST_VERSION = "2"
# Columns of the manifest, of plans and logs, and of the JSON analysis.
MANIFEST_FIELDS = ["relative_path", "file_role", "status", "reason", "group_id", "primary_relative_path", "size_bytes", "xxh128", "nas_path", "primary_nas_path", "manifest_version", "created_at", "nas_root_label", "batch_root", "nas_root"]
LOG_FIELDS = ["disposition", "status", "file_role", "source_path", "destination_path", "duplicate_output_path", "keeper_path", "primary_source_path", "group_id", "event", "reason", "message", "size_bytes", "xxh128", "validation_result", "action_taken", "hash_check", "observed_hash", "input_root", "mode", "timestamp"]
JSON_FIELDS = ["group_id", "json_key", "status", "primary_source_path", "source_path", "json_value", "value_sha256", "value_count_in_group", "json_sidecar_count", "reason", "message"]
# Suffixes of primary images.
PRIMARY_SUFFIXES = [".jpg", ".jpeg", ".heic", ".heif", ".png", ".tif", ".tiff", ".webp", ".gif", ".avif", ".dng", ".raw", ".arw", ".cr2", ".cr3", ".nef", ".orf", ".rw2", ".raf", ".srw"]
ROLES = ["primary", "sidecar", "uncategorized"]
STATUSES = ["included", "skipped"]
ANALYSIS_REQUIRED = ["destination_path", "disposition", "file_role", "group_id", "input_root", "size_bytes", "status"]
EXECUTION_REQUIRED = ["destination_path", "disposition", "duplicate_output_path", "file_role", "group_id", "primary_source_path", "size_bytes", "source_path"]
OUTPUT_DISPOSITIONS = ["planned_duplicate_primary", "planned_duplicate_sidecar", "planned_duplicate_uncategorized"]
MERGE_DISPOSITION = "planned_sidecar_merge"
KEEPER_DISPOSITIONS = ["kept_duplicate_keeper", "kept_duplicate_uncategorized"]
#: Key that stands for any JSON sidecar when their contents are ignored.
JSON_KEY = "__json_sidecar__"
