"""Reading tables from files and responses, and writing results."""
