"""Readers and writers: logs, JSON lines, manifests, reports, audit trails."""
