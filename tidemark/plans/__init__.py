"""Registered queries: an operator bound to the driver's tables, beside its oracle SQL."""
