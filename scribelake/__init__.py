"""Transcript analytics expressed as Spark DataFrame jobs and streams."""

from scribelake.session import checkpointed, local_session

__all__ = ["checkpointed", "local_session"]
