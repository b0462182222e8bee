"""Post-training data preparation, reward scoring and run analytics on Spark."""
