"""newsiq: news-intelligence data work as Spark DataFrame operators."""

from newsiq.session import configure, get_session

__all__ = ["configure", "get_session"]
