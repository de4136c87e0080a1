from netquarry.sources.tables import table  # noqa: F401
