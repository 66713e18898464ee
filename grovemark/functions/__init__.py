"""Part of grovemark."""
