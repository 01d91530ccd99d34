"""Sources and sinks: files by format, JDBC, SQLite, metadata."""
