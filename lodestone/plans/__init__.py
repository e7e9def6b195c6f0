"""Whole queries: pipelines, reports and the registered queries."""
