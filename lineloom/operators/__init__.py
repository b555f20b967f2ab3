"""Operators of the line-history engine."""
