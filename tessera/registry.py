"""All registered queries of the engine, and their SQL."""

from tessera import catalog, catalog_crawl, catalog_mining, catalog_scalars, catalog_social

__all__ = ["ORACLE_SQL", "QUERIES", "catalog", "catalog_crawl", "catalog_mining", "catalog_scalars", "catalog_social"]

QUERIES = catalog.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL
