"""Subpackage of claimboard."""
