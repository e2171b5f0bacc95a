"""Document layout and fidelity analytics on Spark."""
