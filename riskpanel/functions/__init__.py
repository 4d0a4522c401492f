"""Column expressions; nothing in this package triggers a job."""
