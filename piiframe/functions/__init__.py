"""piiframe functions."""
