"""strata: an evidence-retrieval and dataset-building engine expressed in Spark."""
