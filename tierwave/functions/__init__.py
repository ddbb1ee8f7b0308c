"""functions of tierwave; see the modules."""
