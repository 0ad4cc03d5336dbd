"""Errors, one class per status."""

from __future__ import annotations


class KvError(Exception):
    """A status with a message; its text is `Name: message`."""

    def __init__(self, message: str = ""):
        super().__init__(message)
        self.message = message

    def annotate(self, note: str) -> KvError:
        return type(self)(f"{note}: {self.message}")

    def __str__(self) -> str:
        return f"{type(self).__name__}: {self.message}"


class AlreadyExists(KvError): ...


class AsyncError(KvError): ...


class CompressionError(KvError): ...


class Corruption(KvError): ...


class InvalidArgument(KvError): ...


class InvalidData(KvError): ...


class IOFailure(KvError): ...


class LockError(KvError): ...


class NotFound(KvError): ...


class NotSupported(KvError): ...


class PermissionDenied(KvError): ...


class Unknown(KvError): ...
