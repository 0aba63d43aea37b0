"""Named queries over the bound tables."""


def load():
    """(queries, sql twins); importing the modules registers them."""
    from wellspan.catalog import field_facts, followup, io_streams, models, planning, scores, tables  # noqa: F401
    from wellspan.catalog.ctes import with_ctes
    from wellspan.catalog.registry import ORACLE, QUERIES

    return QUERIES, {name: with_ctes(sql) for name, sql in ORACLE.items()}
