"""Tessera: batch, event-time and text analytics written with the Spark DataFrame API."""
