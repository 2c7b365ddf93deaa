"""corrmatch: find which files of one corpus correspond to which of another, on Spark."""
