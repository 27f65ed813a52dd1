"""trapline: camera-trap analytics on Spark (DataFrame / SQL / Structured Streaming).

The public functions take and return DataFrames; see README.md for the
layout and COVERAGE.md for the operator map.
"""
from trapline.functions.dates import capture_date, exif_date
from trapline.functions.taxonomy import display_species, species_info, with_taxonomy
from trapline.operators.breaker import SharedBreaker
from trapline.operators.detections import (
    best_detections,
    best_per_image,
    detections_array,
    detections_table,
    first_n_wide,
    image_detection_counts,
    parse_predictions,
)
from trapline.operators.incremental import failure_streaks, pending_images, resume_union, run_summary
from trapline.operators.labels import daily_label_counts, with_report_date, with_report_label
from trapline.operators.names import (
    names_frame,
    with_category_label,
    with_names,
    with_resolved_vernacular,
    with_vernacular,
)
from trapline.operators.reports import (
    category_frequency,
    confidence_bands,
    daily_label_pivot,
    result_metadata,
    result_page,
    species_frequency,
    species_list,
    summary_report,
    summary_totals,
)
from trapline.operators.routing import dedup_destinations, folder_counts, routing_plan, routing_stats
from trapline.operators.scoring import ScoringOptions, score_images
from trapline.sinks.archive import Archive
from trapline.sinks.csv_excel import join_report, write_excel_csv, write_report_csv
from trapline.sinks.files import execute_routing
from trapline.sinks.manifest import write_manifest
from trapline.sinks.manifest_document import write_manifest_document
from trapline.sinks.sequenced import append_batch, read_page, read_sequenced, table_metadata
from trapline.sinks.tables import append_detections, read_table
from trapline.sources.detections_csv import read_detections_csv
from trapline.sources.exif import capture_dates, capture_dates_for, read_exif
from trapline.sources.folders import scan_tree
from trapline.sources.images import file_list, list_images
from trapline.sources.names_json import read_names
from trapline.sources.predictions import read_predictions
from trapline.streaming.ingest import ingest_images, ingest_stream
from trapline.streaming.live_counts import count_stream, read_counts
from trapline.streaming.progress import latest_progress, read_progress, recorded

__all__ = [name for name in dir() if not name.startswith("_")]
