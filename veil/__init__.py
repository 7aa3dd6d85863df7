"""veil: find, hide and audit sensitive values in tables and streams, as Spark jobs."""
