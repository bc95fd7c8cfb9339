"""From files to positioned, flagged chunks."""
