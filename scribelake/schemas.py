"""Explicit schemas, as DDL, of every document the engine reads; nothing is inferred."""

from __future__ import annotations

NATIVE_DOCUMENT = (
    "run_id STRING, source_id STRING, "
    "transcription ARRAY<STRUCT<offsets:STRUCT<`from`:BIGINT,`to`:BIGINT>,text:STRING>>, "
    "_corrupt_record STRING"
)
SOURCE_CLOCK = ("source_id STRING, frames BIGINT, rate INT")
SEGMENTS = (
    "source_id STRING, idx INT, start_seconds DOUBLE, end_seconds DOUBLE, global_start_seconds DOUBLE, "
    "global_end_seconds DOUBLE, native_start_milliseconds BIGINT, native_end_milliseconds BIGINT, "
    "endpoint_rounding_clamped BOOLEAN, timestamp_valid BOOLEAN, text STRING"
)
IDENTITY = "STRUCT<device:BIGINT,inode:BIGINT,size_bytes:BIGINT,mtime_ns:BIGINT,ctime_ns:BIGINT>"
SOURCE = (
    "STRUCT<id:STRING,`order`:INT,original_basename:STRING,path:STRING,sha256:STRING,size_bytes:BIGINT,"
    f"ownership:STRING,external_path:STRING,recorded_at:STRING,external_identity:{IDENTITY}>"
)
SESSION_DOCUMENT = (
    "id STRING, schema_version INT, recorded_at STRING, processing_status STRING, source_order ARRAY<STRING>, "
    f"sources ARRAY<{SOURCE}>, runs ARRAY<STRING>, _corrupt_record STRING"
)
RUN_DOCUMENT = (
    "session_id STRING, run_id STRING, state STRING, fingerprint STRING, application_version STRING, "
    "model_sha256 STRING, runtime_sha256 STRING, settings STRING, transform_identity STRING, media_identity STRING, "
    "started_at STRING, completed_at STRING, "
    "coverage ARRAY<STRUCT<source_id:STRING,source_sha256:STRING,duration_seconds:DOUBLE,global_offset_seconds:DOUBLE>>, "
    "output_hashes MAP<STRING,STRING>, quality STRUCT<status:STRING,timestamp_valid:BOOLEAN>, _corrupt_record STRING"
)
REPORT_DOCUMENT = (
    "batch_id STRING, created_at STRING, title STRING, state STRING, report_sha256 STRING, "
    "ordered_sources ARRAY<STRUCT<position:INT,filename:STRING,state:STRING,sha256:STRING,duration_seconds:DOUBLE,"
    "duplicate_of:INT>>, "
    "groups ARRAY<STRUCT<indices:ARRAY<INT>,title:STRING,date:STRING,start_time:STRING,confirmed:BOOLEAN>>, "
    "_corrupt_record STRING"
)
PROFILE_DOCUMENT = (
    "schema_version INT, kind STRING, id STRING, label STRING, language STRING, notes STRING, terms ARRAY<STRING>, "
    "asr MAP<STRING,STRING>, preprocessing MAP<STRING,STRING>, _corrupt_record STRING"
)
PROCESS_SAMPLES = (
    "sample INT, pid INT, ppid INT, rss_bytes BIGINT, cpu_percent DOUBLE, cpu_time STRING"
)
TELEMETRY_EVENTS = (
    "batch_id STRING, sequence BIGINT, elapsed_seconds DOUBLE, kind STRING, stage STRING, name STRING, cache STRING, "
    "hit BOOLEAN, outcome STRING, job_id STRING, attempt_id STRING, `index` INT"
)
PROGRESS_EVENTS = (
    "batch_id STRING, seq BIGINT, elapsed DOUBLE, type STRING, job_id STRING, attempt_id STRING, `index` INT, "
    "state STRING, stage STRING, percent INT"
)
FOLDER_OBSERVATIONS = (
    "observed_at TIMESTAMP, path STRING, kind STRING, version_key STRING, device BIGINT, inode BIGINT, "
    "size_bytes BIGINT, mtime_ns BIGINT, ctime_ns BIGINT, sha256 STRING, wav_ok BOOLEAN, forced BOOLEAN"
)
RECORDINGS = ("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
CONFIG_LAYERS = ("layer STRING, precedence INT, field STRING, value STRING, origin STRING")
ARTIFACTS = (
    "root STRING, path STRING, kind STRING, session_id STRING, source_id STRING, run_id STRING, result_id STRING, "
    "source_sha256 STRING, device BIGINT, inode BIGINT, size BIGINT, allocated BIGINT"
)
