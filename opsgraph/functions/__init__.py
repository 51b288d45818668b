"""Part of opsgraph; see the README."""
