"""Search and content analytics as DataFrame-to-DataFrame operators on Spark."""
