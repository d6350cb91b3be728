"""Operators for preparing training text, each with its checked query in ``queries``."""
