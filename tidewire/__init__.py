"""News and event analytics as Spark plans: sources, merges, joins, scores, clusters, streams."""
