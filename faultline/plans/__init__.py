"""End-to-end jobs (``pipelines``) and the registered query catalog."""
