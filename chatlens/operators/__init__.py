"""Reusable relational building blocks: rollups, spines, pages, top-k, checks."""
