"""Flow schema, rename, scans, fixtures and the results sink."""
