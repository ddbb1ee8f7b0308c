"""sources of tierwave; see the modules."""
