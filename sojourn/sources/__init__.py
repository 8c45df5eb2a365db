"""Table scans and CSV sinks."""
