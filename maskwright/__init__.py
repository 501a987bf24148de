"""Personal-data detection, pseudonymisation and corpus preparation on Spark."""
