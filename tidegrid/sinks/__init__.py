"""Where results go: partitioned tables with a manifest of their files."""
