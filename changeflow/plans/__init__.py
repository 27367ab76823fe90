"""Whole jobs built from the operators, and the checked query catalogue."""
