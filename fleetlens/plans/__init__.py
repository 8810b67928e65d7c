"""Derived inputs, the registered queries and their SQL counterparts."""
