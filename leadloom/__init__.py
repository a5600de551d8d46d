"""leadloom: lead tables and training-data preparation on Spark."""
