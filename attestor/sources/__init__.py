"""Where messages and replies come from and where results go."""
