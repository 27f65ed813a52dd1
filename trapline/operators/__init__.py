"""DataFrame -> DataFrame operators: detections, names, reports, routing, resume, scoring."""
