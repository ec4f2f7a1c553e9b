"""Operators over records, facts, snapshots and the catalog."""
