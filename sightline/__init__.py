"""Sightline: evidence analytics over code, manifests and text as Spark DataFrame jobs."""
