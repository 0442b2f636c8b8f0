"""Streams: watching for new scans, and windowed counts of events."""
