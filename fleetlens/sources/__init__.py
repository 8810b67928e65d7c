"""Readers and writers: traces, position tables, ping topics, polygons."""
