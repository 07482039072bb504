"""Operators for preparing text of court rulings as training data; queries in ``queries``."""
