"""Column functions on message text, links and fingerprints."""
