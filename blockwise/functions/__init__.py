"""Blockwise subpackage."""
