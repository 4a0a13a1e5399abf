"""Operators for preparing training data at scale. Nothing else in graphloom imports this package."""
