"""plotwise: listing and open-city-data analytics as plain Spark DataFrame functions."""
