"""Part of sourcegrove."""
