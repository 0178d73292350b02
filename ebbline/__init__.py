"""Service-interruption risk analytics, written as Spark DataFrame transformations."""
