"""Clickstream analytics and recommendation as Spark DataFrame operators."""

from clickloom.config import Config

__all__ = ["Config"]
