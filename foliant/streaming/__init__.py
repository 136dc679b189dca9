"""Streams and keyed state: progress, admission, rate limits, deduplication of arrivals."""
