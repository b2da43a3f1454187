"""Part of lexspan: sources."""
