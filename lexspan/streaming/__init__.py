"""Part of lexspan: streaming."""
