"""Part of mlquarry."""
