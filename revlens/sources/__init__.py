"""Where reviews come from."""
