"""The analytical queries, from options and tables to results."""
