"""Column expressions and small schema helpers; nothing here starts a job."""
