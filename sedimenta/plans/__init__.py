"""Registered queries and the workspace facade."""
