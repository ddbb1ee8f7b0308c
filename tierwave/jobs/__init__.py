"""jobs of tierwave; see the modules."""
