"""Part of the tessera engine; see README.md."""
