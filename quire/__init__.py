"""A Spark engine over corpora of e-book files in Palm-database containers."""
