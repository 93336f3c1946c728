"""Evidence and change-intelligence engine on Spark."""
