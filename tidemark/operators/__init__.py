"""Stateful and relational operators on bars, signals and trades."""
