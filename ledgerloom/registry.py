"""All registered ledger queries and their SQL: importing the catalogues fills the registers."""

from ledgerloom import catalog, detail_catalog, parse_catalog, plan_catalog, review_catalog, sql_catalog  # noqa: F401
from ledgerloom.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
