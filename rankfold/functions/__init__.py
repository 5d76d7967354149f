"""Part of the engine; see the README for its layout."""
