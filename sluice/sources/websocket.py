"""A WebSocket client of the standard library alone, and MQTT over it."""

from __future__ import annotations

import base64
import hashlib
import os
import socket
import ssl
import struct
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

_GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"  # fixed by RFC 6455
TEXT, BINARY, CLOSE, PING, PONG = 1, 2, 8, 9, 10


class WebSocket:
    """A connection; iterate for (opcode, data) of whole text and binary messages until it closes."""

    def __init__(self, url: str, protocol: str | None = None, timeout: float = 30.0) -> None:
        parts = urlsplit(url)
        if parts.scheme not in ("ws", "wss") or not parts.hostname:
            raise ValueError("not a WebSocket address")
        port = parts.port or (443 if parts.scheme == "wss" else 80)
        self.socket = socket.create_connection((parts.hostname, port), timeout)
        if parts.scheme == "wss":
            self.socket = ssl.create_default_context().wrap_socket(self.socket, server_hostname=parts.hostname)
        self._rest = b""
        key = base64.b64encode(os.urandom(16)).decode()
        path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        lines = [f"GET {path} HTTP/1.1", f"Host: {parts.hostname}:{port}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key}", "Sec-WebSocket-Version: 13"]
        if protocol:
            lines.append(f"Sec-WebSocket-Protocol: {protocol}")
        self.socket.sendall(("\r\n".join(lines) + "\r\n\r\n").encode())
        while b"\r\n\r\n" not in self._rest:
            self._more()
        head, _, self._rest = self._rest.partition(b"\r\n\r\n")
        wanted = base64.b64encode(hashlib.sha1((key + _GUID).encode()).digest())
        if b" 101 " not in head.split(b"\r\n")[0] + b" " or wanted not in head:
            raise ConnectionError("the server refused the upgrade")
        # A quiet stream is no error: from here on reading waits, or does something of ``idle`` in between.
        self.idle: Callable[[], None] | None = None
        self.socket.settimeout(None)

    def keep_alive(self, seconds: float, idle: Callable[[], None]) -> None:
        """Calls ``idle`` whenever nothing has come for so long."""
        self.idle = idle
        self.socket.settimeout(seconds)

    def _more(self) -> None:
        while True:
            try:
                data = self.socket.recv(65536)
                break
            except TimeoutError:
                if getattr(self, "idle", None) is None:
                    raise
                self.idle()
        if not data:
            raise ConnectionError("the connection has ended")
        self._rest += data

    def _read(self, n: int) -> bytes:
        while len(self._rest) < n:
            self._more()
        found, self._rest = self._rest[:n], self._rest[n:]
        return found

    def send(self, opcode: int, data: bytes) -> None:
        mask = os.urandom(4)
        n = len(data)
        size = bytes([128 | n]) if n < 126 else b"\xfe" + struct.pack(">H", n) if n < 65536 else b"\xff" + struct.pack(">Q", n)
        masked = bytes(b ^ mask[i % 4] for i, b in enumerate(data))
        self.socket.sendall(bytes([128 | opcode]) + size + mask + masked)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        try:
            yield from self._messages()
        finally:
            self.socket.close()

    def _messages(self) -> Iterator[tuple[int, bytes]]:
        parts, kind = b"", 0
        while True:
            try:
                first, second = self._read(2)
                n = second & 127
                if n >= 126:
                    n = int.from_bytes(self._read(2 if n == 126 else 8), "big")
                mask = self._read(4) if second & 128 else b""
                data = self._read(n)
            except (ConnectionError, OSError):
                return
            if mask:
                data = bytes(b ^ mask[i % 4] for i, b in enumerate(data))
            opcode = first & 15
            if opcode == CLOSE:
                return
            if opcode == PING:
                self.send(PONG, data)
                continue
            if opcode == PONG:
                continue
            kind, parts = (opcode or kind), (parts + data if opcode == 0 else data)
            if first & 128:
                yield kind, parts
                parts = b""

    def close(self) -> None:
        try:
            self.send(CLOSE, b"")
        except OSError:
            pass
        self.socket.close()


def text_frames(url: str, timeout: float = 30.0) -> Iterator[str]:
    """Every frame that is UTF-8, text or binary, until the connection ends; others are passed over."""
    for _, data in WebSocket(url, timeout=timeout):
        try:
            yield data.decode()
        except UnicodeDecodeError:
            continue


def binary_frames(url: str, timeout: float = 30.0) -> Iterator[bytes]:
    for kind, data in WebSocket(url, timeout=timeout):
        if kind == BINARY:
            yield data


def _length(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = divmod(n, 128)
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def _text(s: str) -> bytes:
    data = s.encode()
    return struct.pack(">H", len(data)) + data


def _packet(kind: int, body: bytes) -> bytes:
    return bytes([kind]) + _length(len(body)) + body


def connect_packet(client_id: str, keep_alive: int) -> bytes:
    return _packet(0x10, _text("MQTT") + b"\x04\x02" + struct.pack(">H", keep_alive) + _text(client_id))


def subscribe_packet(topic: str, qos: int = 1, number: int = 1) -> bytes:
    return _packet(0x82, struct.pack(">H", number) + _text(topic) + bytes([qos]))


PINGREQ = _packet(0xC0, b"")


def split_packets(data: bytes) -> tuple[list[tuple[int, bytes]], bytes]:
    """(first byte, body) of the whole packets in a run of bytes, and what is left."""
    found = []
    while len(data) >= 2:
        n, at, shift = 0, 1, 0
        while at < len(data) and at < 5:
            n |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                break
        else:
            break
        if len(data) < at + n:
            break
        found.append((data[0], data[at : at + n]))
        data = data[at + n :]
    return found, data


def publication(first: int, body: bytes) -> tuple[bytes, int | None]:
    """The payload of a PUBLISH packet, and the number to acknowledge if it asks for that."""
    n = int.from_bytes(body[:2], "big")
    qos = first >> 1 & 3
    at = 2 + n
    number = int.from_bytes(body[at : at + 2], "big") if qos else None
    return body[at + (2 if qos else 0) :], number


def mqtt_messages(url: str = "ws://localhost:8883", topic: str = "test", client_id: str = "test_client", keep_alive: int = 20, retry_s: float = 1.0, attempts: int | None = None) -> Iterator[str]:
    """A topic's messages that are UTF-8, at least once each; after an error it connects and subscribes again.

    ``attempts`` bounds the connections; without it they go on for ever.
    """
    address = f"{url}{'&' if '?' in url else '?'}client_id={client_id}"
    tries = 0
    while attempts is None or tries < attempts:
        tries += 1
        try:
            link = WebSocket(address, "mqtt", timeout=keep_alive / 2)
            link.send(BINARY, connect_packet(client_id, keep_alive))
            link.send(BINARY, subscribe_packet(topic))
            link.keep_alive(keep_alive / 2, lambda link=link: link.send(BINARY, PINGREQ))
            rest = b""
            for _, data in link:
                packets, rest = split_packets(rest + data)
                for first, body in packets:
                    refused = (first >> 4 == 2 and body[1:2] != b"\x00") or (first >> 4 == 9 and body[-1:] == b"\x80")
                    if refused:
                        raise ConnectionError("the broker refused the connection or the topic")
                    if first >> 4 != 3:
                        continue
                    payload, number = publication(first, body)
                    if number is not None:
                        link.send(BINARY, _packet(0x40, struct.pack(">H", number)))
                    try:
                        yield payload.decode()
                    except UnicodeDecodeError:
                        continue
        except OSError as e:
            print(f"MQTT connection failed: {type(e).__name__}")
        if attempts is None or tries < attempts:
            time.sleep(retry_s)
