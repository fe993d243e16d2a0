"""ouvidor: complaint analytics and corpus processing on Spark."""
