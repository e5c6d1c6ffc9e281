"""Listing-feed analytics as Spark jobs."""
