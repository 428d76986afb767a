"""No connections out of the driver's Python while a loop runs."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Iterator
from contextlib import contextmanager


class NetworkDenied(RuntimeError):
    pass


def is_local(address) -> bool:
    """Whether a socket address stays on this machine: a file, a loopback address or its name."""
    if not isinstance(address, tuple):
        return True
    host = address[0]
    if host in ("", "localhost"):
        return True
    try:
        return ipaddress.ip_address(host).is_loopback
    except ValueError:
        return False


@contextmanager
def deny_network(allowed: tuple[str, ...] = ()) -> Iterator[None]:
    """Connections from Python to other machines raise, but for ``allowed`` hosts; Spark's own gateway is on the loopback.

    It guards against slips, not against intent: other processes and the JVM are not bound by it.
    """
    names = ("connect", "connect_ex")
    before = {n: getattr(socket.socket, n) for n in names}

    def guarded(original):
        def connect(self, address):
            if not is_local(address) and address[0] not in allowed:
                raise NetworkDenied(f"no connection to {address[0]} within this block")
            return original(self, address)

        return connect

    try:
        for n in names:
            setattr(socket.socket, n, guarded(before[n]))
        yield
    finally:
        for n in names:
            setattr(socket.socket, n, before[n])
