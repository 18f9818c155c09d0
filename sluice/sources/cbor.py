"""Just enough CBOR and CAR to read firehose frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any


class DecodeError(ValueError):
    """The bytes are not what they should be."""


class Tagged(tuple):
    """A tagged value: (tag, value)."""


_BREAK = object()


class Reader:
    """Values of CBOR one after the other."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def _take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise DecodeError("the data ends within a value")
        found = self.data[self.at : self.at + n]
        self.at += n
        return found

    def _length(self, info: int) -> int | None:
        if info < 24:
            return info
        if info <= 27:
            return int.from_bytes(self._take(1 << (info - 24)), "big")
        if info == 31:
            return None
        raise DecodeError("reserved length")

    def value(self, depth: int = 0) -> Any:
        if depth > 128:
            raise DecodeError("nested too deeply")
        head = self._take(1)[0]
        major, info = head >> 5, head & 31
        if major == 7:
            return self._simple(info)
        n = self._length(info)
        if major in (0, 1):
            if n is None:
                raise DecodeError("a number without length")
            return n if major == 0 else -1 - n
        if major in (2, 3):
            return self._string(major, n)
        if major == 4:
            return list(self._items(n, depth))
        if major == 5:
            found = {}
            keys = self._items(n, depth)
            for key in keys:
                if isinstance(key, (list, dict)):
                    raise DecodeError("a key that is no plain value")
                found[key] = self.value(depth + 1)
            return found
        if n is None:
            raise DecodeError("a tag without number")
        return Tagged((n, self.value(depth + 1)))

    def _items(self, n: int | None, depth: int):
        while n is None or n > 0:
            item = self.value(depth + 1)
            if item is _BREAK:
                if n is not None:
                    raise DecodeError("unexpected break")
                return
            yield item
            n = None if n is None else n - 1

    def _string(self, major: int, n: int | None) -> bytes | str:
        if n is not None:
            raw = self._take(n)
        else:
            raw = b""
            while (part := self.value()) is not _BREAK:
                raw += part.encode() if isinstance(part, str) else part
        try:
            return raw if major == 2 else raw.decode()
        except UnicodeDecodeError as e:
            raise DecodeError("text that is not UTF-8") from e

    def _simple(self, info: int) -> Any:
        if info in (20, 21, 22, 23):
            return {20: False, 21: True, 22: None, 23: None}[info]
        if info == 24:
            return self._take(1)[0]
        if info in (25, 26, 27):
            return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[info], self._take(1 << (info - 24)))[0]
        if info == 31:
            return _BREAK
        return info


def decode(data: bytes) -> Any:
    found = Reader(data).value()
    if found is _BREAK:
        raise DecodeError("unexpected break")
    return found


def _varint(data: bytes, at: int) -> tuple[int, int]:
    found = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise DecodeError("bad varint")
        byte = data[at]
        at += 1
        found |= (byte & 127) << shift
        if byte < 128:
            return found, at
        shift += 7


def car_blocks(data: bytes) -> Iterator[bytes]:
    """The blocks' contents of a CAR archive, without their content ids; what comes before an error is given."""
    n, at = _varint(data, 0)
    at += n
    while at < len(data):
        n, at = _varint(data, at)
        end = at + n
        if end > len(data) or n == 0:
            raise DecodeError("the archive ends within a block")
        if data[at : at + 2] == b"\x12\x20":  # a version 0 id is a bare SHA-256 multihash
            start = at + 34
        else:
            _, start = _varint(data, at)  # version
            _, start = _varint(data, start)  # codec
            _, start = _varint(data, start)  # hash function
            size, start = _varint(data, start)
            start += size
        if start > end:
            raise DecodeError("a content id longer than its block")
        yield data[start:end]
        at = end


def encode(value: Any) -> bytes:
    """CBOR of plain values, for frames to replay and to test with."""
    if value is None or isinstance(value, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[value]
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, bytes):
        return _head(2, len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, (list, tuple)):
        return _head(4, len(value)) + b"".join(map(encode, value))
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(encode(k) + encode(v) for k, v in value.items())
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    raise TypeError(f"{type(value).__name__} cannot be encoded")


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for info, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * size):
            return bytes([major << 5 | info]) + n.to_bytes(size, "big")
    raise ValueError("too large a number")


def encode_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode_car(blocks: list[bytes]) -> bytes:
    """A CAR archive of blocks under version 1 content ids."""
    import hashlib

    head = encode({"roots": [], "version": 1})
    out = encode_varint(len(head)) + head
    for block in blocks:
        content = b"\x01\x71\x12\x20" + hashlib.sha256(block).digest()
        out += encode_varint(len(content) + len(block)) + content + block
    return out
