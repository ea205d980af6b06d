"""Part of stratiform."""
