"""A Spark engine for corpora of structured documents and their tracked changes."""
