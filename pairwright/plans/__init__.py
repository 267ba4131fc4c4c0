"""Queries over the logical tables; importing queries fills the registry."""
