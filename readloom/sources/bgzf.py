"""Blocked gzip: random access by virtual offset (file offset of a block << 16 | offset within it), and writing."""

from __future__ import annotations

import struct
import zlib

#: The empty block that ends a file (fixed by the format).
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
LIMIT = 0xFF00


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class Reader:
    def __init__(self, path: str, voffset: int = 0):
        self.file = open(path, "rb")  # noqa: SIM115
        self.seek(voffset)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def seek(self, voffset: int) -> None:
        self.file.seek(voffset >> 16)
        self.data, self.at, self.start, self.next = b"", 0, voffset >> 16, voffset >> 16
        self._load()
        self.at = voffset & 0xFFFF

    def _load(self) -> bool:
        """The next block with data; False at the end."""
        while True:
            self.start = self.next
            head = self.file.read(12)
            if len(head) < 12:
                self.data, self.at = b"", 0
                return False
            if head[:2] != b"\x1f\x8b":
                raise ValueError("not a blocked gzip file")
            extra, size = self.file.read(struct.unpack_from("<H", head, 10)[0]), None
            k = 0
            while k < len(extra):
                a, b, n = struct.unpack_from("<BBH", extra, k)
                if (a, b) == (66, 67):
                    size = struct.unpack_from("<H", extra, k + 4)[0] + 1
                k += 4 + n
            if size is None:
                raise ValueError("a gzip block without a size")
            body = self.file.read(size - 12 - len(extra))
            self.next = self.start + size
            self.data, self.at = zlib.decompress(body[:-8], -15), 0
            if self.data:
                return True

    def tell(self) -> int:
        if self.at >= len(self.data):
            return self.next << 16
        return self.start << 16 | self.at

    def read(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        while len(out) < n and self._load():
            more = self.data[: n - len(out)]
            self.at = len(more)
            out += more
        return out


class Writer:
    def __init__(self, file):
        self.file, self.buffer = file, bytearray()

    def write(self, data: bytes) -> None:
        self.buffer += data
        while len(self.buffer) >= LIMIT:
            self.file.write(block(bytes(self.buffer[:LIMIT])))
            del self.buffer[:LIMIT]

    def flush(self) -> None:
        if self.buffer:
            self.file.write(block(bytes(self.buffer)))
            self.buffer.clear()
