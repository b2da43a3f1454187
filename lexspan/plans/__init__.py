"""Part of lexspan: plans."""
