"""Whole jobs: derived tables, data-quality reports, and the registered queries."""
