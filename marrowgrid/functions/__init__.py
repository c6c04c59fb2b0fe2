"""Column expressions: no job is started here."""
