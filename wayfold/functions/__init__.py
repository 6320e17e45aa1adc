"""Column builders and small driver-side helpers."""
