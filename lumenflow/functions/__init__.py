"""Part of lumenflow."""
