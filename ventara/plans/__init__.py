"""Session settings, the sales schema and period arithmetic."""
