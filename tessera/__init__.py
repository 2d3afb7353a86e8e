"""Tessera: a PySpark-native engine for select-project-join-aggregate SQL and cyclic multiway joins."""

from tessera.engine import Engine
from tessera.session import build_session

__all__ = ["Engine", "build_session"]
