"""Named queries over the star-schema tables, each with its SQL twin where SQL can say it."""
from importlib import import_module

MODULES = ["q_controls", "q_policy", "q_change", "q_text", "q_retrieval", "q_streaming", "q_more", "q_identify", "q_catalog", "q_json", "q_whatif", "q_files"]


def load_all():
    """(queries, SQL twins) of every query module."""
    from .registry import ORACLE, QUERIES
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return dict(QUERIES), dict(ORACLE)
