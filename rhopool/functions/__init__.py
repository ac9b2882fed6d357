"""Column-level functions; nothing here triggers a job."""
