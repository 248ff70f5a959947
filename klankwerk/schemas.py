"""Schemas, as DDL strings, of the tables, nested documents, queue messages and export shards, and fixed values."""

from __future__ import annotations

#: Fixed values of the token format.
BOS, EOS, PAD = 1026, 1024, 1025
CHANNELS = 9
DELAY = (0, 8, 9, 10, 11, 12, 13, 14, 15)
TEXT_LENGTH, AUDIO_LENGTH = 1024, 3072
CODEBOOK = 1024
CHUNKS_PER_SHARD = 40_000
TEXT_CLEAN_P, TEXT_DROPOUT_P = 0.1, 0.15

#: Fixed values of the sampling and class-balance statistics.
ALPHA, TAU, P_MIN, P_MAX = 0.35, 1800.0, 5e-5, 5e-2
BETA, UNIT_SEC, W_MIN, W_MAX = 0.9999, 60.0, 0.5, 3.0

#: Parameters of a job that does not bring its own, and those a job is queued with.
WINDOW_SEC, SKIP_START_SEC, SKIP_END_SEC = 30.0, 80.0, 80.0
QUEUED_SKIP_START_SEC, QUEUED_SKIP_END_SEC = 120.0, 180.0
MIN_CHUNK_SEC = 1.0

SPEAKERS = "id int, embedding array<float>, created_at timestamp"
AUDIO_FILES = "id int, original_file_path string, audio_duration_sec double, processing_window_start double, processing_window_end double, success boolean, created_at timestamp"
AUDIO_CHUNKS = (
    "id int, audio_file_id int, chunk_file_path string, start_time_ms int, end_time_ms int, transcription string, transcription_conf double, "
    "transcription_clean string, transcription_clean_conf double, created_at timestamp"
)
AUDIO_EVENTS = "id int, audio_file_id int, chunk_id int, speaker_id int, start_time_sec double, end_time_sec double, speaker_label string, created_at timestamp"

TURN = "start: double, end: double, speaker: string"
CHUNK = f"start: double, end: double, speaker_events: array<struct<{TURN}>>, file_path: string, gcs_file_path: string"
CHUNK_TEXT = f"audio_chunk: struct<{CHUNK}>, transcription: string, transcription_clean: string"
FILE_RESULT = f"source_file string, gcs_audio_path string, audio_duration_sec double, chunks array<struct<{CHUNK_TEXT}>>, success boolean, processing_window map<string, double>"

JOB = "audio_file_path string, window_size_sec double, skip_start_sec double, skip_end_sec double, timestamp double"
TRANSCRIPTION_JOB = (
    f"job_id string, chunk_id string, chunk_path string, gcs_audio_path string, audio_file_id bigint, chunk_data struct<{CHUNK}>, "
    "speaker_embeddings map<string, array<double>>, timestamp double"
)
EXPORT = (
    "source_file string, chunk_id string, start_ms double, end_ms double, duration_ms double, transcription string, transcription_clean string, file_path string, "
    "chunk_owner bigint, sample_prob double, cb_weight double, encoded_audio_shape array<bigint>, encoded_audio array<bigint>"
)
