"""Sources and sinks: topics, tables, dimension snapshots."""
