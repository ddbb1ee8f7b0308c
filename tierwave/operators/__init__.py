"""operators of tierwave; see the modules."""
