"""Part of strandex."""
