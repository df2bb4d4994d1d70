"""piiframe operators."""
