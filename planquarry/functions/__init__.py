"""Part of planquarry."""
