"""The lazy table query API."""
