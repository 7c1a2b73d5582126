"""Schemas of the catalogue's tables and the domains of their enumerations."""

INTERVIEWS = "id INT, interview_date TIMESTAMP_NTZ, interview_type STRING, interview_subject_type STRING, status STRING, keywords ARRAY<STRING>, created_at TIMESTAMP, updated_at TIMESTAMP"
AUDIO = "id INT, interview_audio_path STRING, interview_audio_format STRING, interview_audio_size BIGINT, interview_id INT, created_at TIMESTAMP"
RESULTS = "id INT, interview_transcription_file_path STRING, interview_id INT, summary_file_path STRING, created_at TIMESTAMP"
JOBS = "id INT, interview_id INT, status STRING, error_message STRING, raw_transcript_path STRING, current_step STRING, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ, created_at TIMESTAMP, updated_at TIMESTAMP"
WORDS = "ARRAY<STRUCT<start_ms: BIGINT, end_ms: BIGINT, text: STRING>>"
SEGMENTS = f"interview_id INT, pos INT, start_ms BIGINT, end_ms BIGINT, text STRING, words {WORDS}"
RAW_SEGMENTS = f"interview_id INT, pos INT, t0 BIGINT, t1 BIGINT, text STRING, words {WORDS}"
SPEAKER_TURNS = "interview_id INT, start_ms BIGINT, end_ms BIGINT, speaker_id INT"
TURNS = "interview_id INT, pos INT, start_ms BIGINT, end_ms BIGINT, speaker STRING, text STRING"
TRANSCRIPT_JSON = "version INT, speaker_source STRING, notice STRING, turns ARRAY<STRUCT<start_ms: BIGINT, end_ms: BIGINT, speaker: STRING, text: STRING>>"
DOCUMENT_JSON = "id INT, has_speakers BOOLEAN, has_timestamps BOOLEAN, speaker_source STRING, edited BOOLEAN, notice STRING, summary STRING, speakers ARRAY<STRUCT<key: STRING, label: STRING>>, blocks ARRAY<STRUCT<speaker: STRING, start: DOUBLE, end: DOUBLE, text: STRING>>"

# Domains of status, role, source and step columns, steps in their order.
INTERVIEW_STATUS = ["pending_audio", "pending_processing", "processing", "completed", "failed"]
JOB_STATUS = ["pending", "running", "completed", "failed"]
ACTIVE_JOB = ["pending", "running"]
ROLES = ["interviewer", "subject"]
SPEAKER_SOURCES = ["none", "diarization", "manual"]
STEPS = ["normalizando_audio", "transcribiendo", "diarizando", "aplicando_glosario", "corrigiendo_texto", "anonimizando", "generando_resumen"]
