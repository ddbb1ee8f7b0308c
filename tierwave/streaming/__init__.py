"""streaming of tierwave; see the modules."""
