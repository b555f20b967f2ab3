"""Text and CSV reports of small results."""
