"""Structured Streaming counterparts of the keyed load and the detection windows."""
