"""strataform: a Spark-first analytics engine with a MySQL-flavoured query surface."""

from strataform.session import local_session, table

__all__ = ["local_session", "table"]
