"""cairn: evidence-graph analytics as Spark DataFrame plans."""
