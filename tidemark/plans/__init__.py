"""Query plans: each module registers its queries on import."""

from importlib import import_module

MODULES = ["scans", "landing", "joins", "windows", "reports", "technical", "research", "stats", "text_options_streams"]


def load_all() -> None:
    for m in MODULES:
        import_module(f"tidemark.plans.{m}")
