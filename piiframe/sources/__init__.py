"""piiframe sources."""
