"""Distributed operators (DataFrame API; no driver-side loops over rows)."""
