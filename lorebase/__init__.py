"""Knowledge-base, retrieval and training-data jobs on Spark."""
