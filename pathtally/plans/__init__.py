"""Run configurations, analyses and reports."""
