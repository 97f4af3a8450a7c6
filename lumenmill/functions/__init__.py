"""Part of the sample-generation engine."""
