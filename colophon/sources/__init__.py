"""Readers: harvested pages, logs, bitstreams, side inputs."""
