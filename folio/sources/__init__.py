"""Readers, stored tables and the views over the synthetic tables."""
