"""Part of tilewright."""
