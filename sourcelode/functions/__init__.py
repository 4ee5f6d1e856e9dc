"""Column expressions and fixed lookup data; nothing here triggers a job."""
