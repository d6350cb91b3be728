"""Queries over the driver's tables, each next to the plain SQL that checks it."""

MODULES = ["feed", "text", "classify", "lifecycle", "vendors", "boards", "crawl", "streams"]


def load_all() -> None:
    """Import every check module once; importing registers its queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"checks.{name}")
