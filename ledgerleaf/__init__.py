"""Evidence, rule and corpus analytics for Spark."""
