"""Set-based operators for turn-based card tables, written for Spark."""
