"""polygate: query Spark in the SQL dialect you already use."""

from polygate.dialect import Options
from polygate.gateway import Gateway
from polygate.lexer import Dialect
from polygate.session import Session, open_session
from polygate.sources.store import Store

__all__ = ["Dialect", "Gateway", "Options", "Session", "Store", "open_session"]
