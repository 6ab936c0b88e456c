"""Part of hunkmill; see README.md."""
