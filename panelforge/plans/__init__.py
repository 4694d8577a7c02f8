"""Derived tables that queries start from."""
