"""Schemas of the tables that operators take and give."""

from __future__ import annotations

BLOCK = "struct<size: bigint, replicas: array<string>>"
STORAGE = f"array<struct<hdfsBlockInfos: array<{BLOCK}>>>"

SERVERS = "server string, hostname string, ip string"
SERVER_METRICS = "server string, p75_read_latency double, compaction_queue_size int"
REGIONS = "table_name string, encoded_name string, start_key binary, end_key binary, server string, table_disabled boolean"
REGION_STATS = (
    "regionInfo struct<table_name: string, encoded_name: string, start_key: binary, end_key: binary>, serverName string, "
    f"size bigint, modificationTime bigint, loadWeight double, serverStorage {STORAGE}"
)
FILES = "region_path string, path string, length bigint, modification_time bigint, visible boolean"
CELLS = "row binary, family binary, qualifier binary, ts bigint, value binary"
REGION_LOAD_METRICS = (
    "stores", "storefiles", "storefileSizeMB", "memstoreSizeMB", "storefileIndexSizeMB", "readRequestsCount", "writeRequestsCount",
    "rootIndexSizeKB", "totalStaticIndexSizeKB", "totalStaticBloomSizeKB", "totalCompactingKVs", "currentCompactedKVs",
)
REGION_LOAD = "server string, region_name string, snapshot_ts timestamp, " + ", ".join(f"{m} bigint" for m in REGION_LOAD_METRICS)
TRANSITION_POLLS = "poll_id bigint, poll_ts timestamp, region string"
REQUESTS = "server string, ts timestamp, ok boolean"

#: The modification time of a region without files.
NO_TIME = -(1 << 63)
