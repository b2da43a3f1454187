"""Part of lexspan: functions."""
