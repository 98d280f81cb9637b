"""Append-only shards as a stream."""
