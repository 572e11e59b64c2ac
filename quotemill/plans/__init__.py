"""Whole plans and registered queries."""
