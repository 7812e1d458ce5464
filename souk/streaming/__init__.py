"""Event streams: parsing, classification, sinks and telemetry."""
