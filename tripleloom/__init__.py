"""Knowledge-graph measurement, synthesis and comparison on Spark."""
