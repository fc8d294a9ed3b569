"""Part of tarnwork."""
