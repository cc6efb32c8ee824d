"""canopy: re-identification and training-data analytics, declared as Spark plans."""
