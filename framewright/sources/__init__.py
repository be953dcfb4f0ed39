"""Sources and sinks: image files and zips, label files, keyed tables, reports."""
