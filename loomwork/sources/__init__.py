"""Files, bytes and URLs as typed tables."""
