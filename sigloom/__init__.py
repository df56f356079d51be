"""sigloom: security-telemetry analytics and corpus preparation as Spark jobs."""
