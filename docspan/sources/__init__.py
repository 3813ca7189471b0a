"""Sources and sinks: JSON, CSV, the file store, stored collections."""
