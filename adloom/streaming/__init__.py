"""Ads that keep arriving."""
