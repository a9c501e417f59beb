"""Structured Streaming forms of ingest (R1), running metric (R2/U6) and
decontamination (R3).  All use file sources, checkpoints in the shared
folder and ``Trigger.AvailableNow`` so a run processes what has landed and
stops; re-running resumes from the checkpoint."""

from .streams import decontaminate_stream, ingest_stream, running_metric_stream  # noqa: F401
