"""Evidence analytics and training-data operators on Spark."""
