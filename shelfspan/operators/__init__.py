"""Reusable DataFrame operators: conformance, keys, lookups, ordered fills."""
