"""Part of the shade-network analytics library."""
