"""Column expressions: no function in here triggers a job or a shuffle."""
