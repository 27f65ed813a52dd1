"""Sinks: the Parquet detections table, Excel-readable CSV reports, manifests, file copies."""
