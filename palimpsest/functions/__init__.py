"""Column functions; Python only where built-in expressions cannot say it (noise, envelopes, JSON leaves)."""
