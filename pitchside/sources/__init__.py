"""Sources and sinks: landed parquet/JSON readers, the driver-table mapping, writers."""
