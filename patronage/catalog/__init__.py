"""Named queries: each pairs a Spark callable with the SQL that must give the same rows."""
import importlib

QUERIES: dict = {}
ORACLES: dict = {}
MODULES = ["metrics", "linkage", "customers", "sheets", "partner", "intake", "operations", "streams"]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may name any CRM view or base table."""
    from patronage.sources.bindings import Tables, with_views

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def load() -> tuple:
    for module in MODULES:
        importlib.import_module(f"patronage.catalog.{module}")
    return QUERIES, ORACLES
