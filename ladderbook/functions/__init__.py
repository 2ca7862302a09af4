"""Part of ladderbook."""
