"""Message-traffic anomaly analytics as Spark jobs."""
