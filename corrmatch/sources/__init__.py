"""Readers of workspaces."""
