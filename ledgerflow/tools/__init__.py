"""Tools for authors of pipelines."""
