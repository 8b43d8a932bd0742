"""Errors of the engine.  Every failed statement carries SQLSTATE 42000; codes and retryability follow fixed tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from enum import IntEnum

from pyspark.errors import PySparkException


class Code(IntEnum):
    """General, RPC, storage, transaction and replication codes."""

    OK = 0
    UNKNOWN = 1
    INTERNAL = 2
    NOT_READY = 3
    CONFIG = 4
    RPC_TIMEOUT = 1000
    RPC_UNAVAILABLE = 1001
    RPC_NETWORK_ERROR = 1002
    STORAGE_IO = 2000
    STORAGE_CORRUPTION = 2001
    STORAGE_FULL = 2002
    KEY_NOT_FOUND = 2003
    KEY_EXISTS = 2004
    TXN_CONFLICT = 3000
    TXN_DEADLOCK = 3001
    TXN_TIMEOUT = 3002
    TXN_ABORTED = 3003
    RAFT_NOT_LEADER = 4000
    RAFT_PROPOSAL_DROPPED = 4001
    RAFT_LEADERSHIP_CHANGED = 4002


RETRYABLE = {Code.RPC_TIMEOUT, Code.RPC_UNAVAILABLE, Code.TXN_CONFLICT, Code.TXN_DEADLOCK, Code.RAFT_NOT_LEADER, Code.RAFT_LEADERSHIP_CHANGED}


class EngineError(Exception):
    sqlstate = "42000"

    def __init__(self, message: str, code: Code = Code.UNKNOWN):
        super().__init__(message)
        self.code = code

    @property
    def retryable(self) -> bool:
        return self.code in RETRYABLE


@contextmanager
def told() -> Iterator[None]:
    """What fails inside, while planning or running, is an error of the statement."""
    try:
        yield
    except PySparkException as e:
        raise EngineError(str(e).split("\n\nJVM stacktrace")[0]) from e
