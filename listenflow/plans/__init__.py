"""Query registry and physical-plan checks."""
