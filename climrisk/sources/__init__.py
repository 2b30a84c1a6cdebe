"""Readers for raw payloads and writers for keyed tables."""
