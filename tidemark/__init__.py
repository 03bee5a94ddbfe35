"""Point-in-time market and event analytics as DataFrame-to-DataFrame functions on Spark."""
