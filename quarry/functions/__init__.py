"""functions of the curation engine."""
