"""piiframe: finding, tokenising and restoring sensitive values in DataFrames."""

__version__ = "0.1.0"
