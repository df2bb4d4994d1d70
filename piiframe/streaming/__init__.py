"""piiframe streaming."""
