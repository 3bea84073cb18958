"""Sources and sinks: delimited text, JSON, spreadsheets, compressed files."""
