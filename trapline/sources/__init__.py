"""Sources: image listings, detections CSV, name dictionaries, model output, EXIF tags."""
