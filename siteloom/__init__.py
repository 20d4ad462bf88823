"""siteloom: site-audit analytics as Spark jobs."""
