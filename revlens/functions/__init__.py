"""Column functions: cleaning, language, fake signals, sentiment."""
