"""Part of docweave."""
