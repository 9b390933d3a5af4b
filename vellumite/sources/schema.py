"""Fixed schemas of nested documents. Free-form parts stay JSON text."""

from __future__ import annotations

BOX = "array<double>"
REGION = f"struct<id: string, kind: string, bbox: {BOX}, text: string, cells: array<array<string>>, metadata: string>"
UNIT = f"struct<id: string, kind: string, number: int, width: double, height: double, regions: array<{REGION}>>"
CONTENT = f"doc_id string, schema_version string, format string, source_sha256 string, backend string, warnings array<string>, units array<{UNIT}>"
PREDICTION = f"source_sha256 string, source_name string, backend string, backend_version string, settings string, coordinate_system string, pages array<struct<number: int, width: double, height: double, rotation: int, regions: array<struct<id: string, kind: string, bbox: {BOX}, text: string, cells: array<array<string>>>>>>"
REFERENCE = f"source_sha256 string, source_name string, coordinate_system string, reviewed boolean, reviewed_by string, pages array<struct<number: int, width: double, height: double, rotation: int, tasks: array<string>, text: string, tables: array<struct<id: string, bbox: {BOX}, cells: array<array<string>>>>, figures: array<struct<id: string, bbox: {BOX}>>>>"
FINDING = "struct<region_id: string, value: string, category: string, method: string, spans: array<struct<start: int, end: int>>>"
TELEMETRY = "run_id string, event string, time double, seconds double, source_sha256 string, attempt int, segment_attempt int, prompt_eval_count long, eval_count long, eval_duration long, prompt_eval_duration long, load_duration long, total_duration long"
SPAN = "run_id string, stage string, seconds double, status string"
JOB = "job_id string, owner string, filename string, source_sha256 string, options string, request_hash string, idempotency_key string, status string, stage string, worker_id string, assigned_worker_id string, lease string, heartbeat timestamp, error_code string, created timestamp, updated timestamp"
ELEMENT = "doc_id string, page int, y double, kind string, text string, size double, bold boolean"
