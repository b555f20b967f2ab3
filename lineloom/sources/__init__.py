"""Sources of the line-history engine."""
