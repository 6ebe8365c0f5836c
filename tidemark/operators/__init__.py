"""Relational operators over long fact, price and score tables."""
