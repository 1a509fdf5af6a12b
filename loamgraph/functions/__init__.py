"""Part of loamgraph."""
