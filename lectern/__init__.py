"""Text-recognition analytics on Spark."""
