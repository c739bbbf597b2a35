"""Where observations come from."""
