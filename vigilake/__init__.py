"""Surveillance-footage analytics and text-corpus preparation on Spark."""
