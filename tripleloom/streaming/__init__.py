"""Measurements that follow a stream (beyond the batch library)."""
