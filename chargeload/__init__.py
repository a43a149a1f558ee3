"""chargeload: EV charging-session ingestion and load analysis on Spark."""
