"""Plan-level helpers: lineage cuts and shared storage."""
