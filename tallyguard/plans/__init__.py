"""Composite plans: rule finders, rechecks, lifecycle, reports and the batch job."""
