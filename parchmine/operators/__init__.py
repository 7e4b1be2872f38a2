"""Operators that need more than a relational plan."""
