"""Relational operators on workspaces."""
