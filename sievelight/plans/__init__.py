"""Session, staging, joins of checked size, and whole-scan plans."""
