"""piiframe plans."""
