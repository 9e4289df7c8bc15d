"""Readers and writers: feed payloads, catalogue, schedule archives, position log, snapshots."""
