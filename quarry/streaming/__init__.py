"""streaming of the curation engine."""
