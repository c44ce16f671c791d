"""gridloom: hourly energy-price analytics and training-data preparation as Spark jobs."""
