"""Structured Streaming jobs (T01–T07). Event time must be TIMESTAMP (not NTZ) for watermarks."""
