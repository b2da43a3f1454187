"""Part of lexspan: operators."""
