"""Functions of the line-history engine."""
