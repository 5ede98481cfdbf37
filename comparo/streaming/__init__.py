"""Incremental loads. The reports are batch jobs over finished files; the
only incremental behaviour is the monthly append of the share table, made
idempotent here. No watermark or stateful stream exists in the workload."""
