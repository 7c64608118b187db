"""Rating messages and real-time recommendations."""
