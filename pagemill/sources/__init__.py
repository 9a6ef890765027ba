"""Sources and sinks: web pages, job tables, CSV and JSON output."""
