"""Structured Streaming: incremental refresh of the player table from landed snapshots."""
