"""Recipes: ordered steps on a table, and steps suggested from a scan."""
