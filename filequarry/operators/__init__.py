"""Part of filequarry."""
