"""Places from which gzip files that were packed in one go can be unpacked: restart points.

One task unpacks the file once and notes at ends of deflate blocks, some megabytes apart, where it stands: the byte and bit in the file
and the 32 KB before, which what follows may refer to. These go to a file of slots of equal size in the shared folder. Later tasks each
begin at a point of their own. The calls of zlib that this needs are not in Python's module, so that the C library is called.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

from strandflow.sources.places import file_system

_WINDOW, _IN, _OUT = 1 << 15, 1 << 18, 1 << 20
_HEAD = struct.Struct("<QBI")
SLOT = _HEAD.size + _WINDOW
#: Of zlib: stop at the end of a block; results. Fixed values.
_TO_BLOCK, _NO_FLUSH, _OK, _END, _NO_PROGRESS = 5, 0, 0, 1, -5


class _Stream(ctypes.Structure):
    _fields_ = [
        ("next_in", ctypes.c_void_p), ("avail_in", ctypes.c_uint), ("total_in", ctypes.c_ulong), ("next_out", ctypes.c_void_p), ("avail_out", ctypes.c_uint), ("total_out", ctypes.c_ulong),
        ("msg", ctypes.c_char_p), ("state", ctypes.c_void_p), ("zalloc", ctypes.c_void_p), ("zfree", ctypes.c_void_p), ("opaque", ctypes.c_void_p), ("data_type", ctypes.c_int),
        ("adler", ctypes.c_ulong), ("reserved", ctypes.c_ulong),
    ]


@lru_cache
def _library():
    """The C library, or None where there is none: then such files are read by one task."""
    try:
        lib = ctypes.CDLL(ctypes.util.find_library("z") or "libz.so.1")
        lib.zlibVersion.restype = ctypes.c_char_p
        return lib
    except OSError:
        return None


def available() -> bool:
    return _library() is not None


class _Inflater:
    def __init__(self, bits: int):
        self.lib, self.s, self.out = _library(), _Stream(), ctypes.create_string_buffer(_OUT)
        self._check(self.lib.inflateInit2_(ctypes.byref(self.s), bits, self.lib.zlibVersion(), ctypes.sizeof(_Stream)))

    def _check(self, result: int) -> int:
        if result not in (_OK, _END, _NO_PROGRESS):
            raise zlib.error(f"error {result} while unpacking")
        return result

    def resume(self, bits: int, first: int, window: bytes) -> None:
        if bits:
            self._check(self.lib.inflatePrime(ctypes.byref(self.s), bits, first >> (8 - bits)))
        self._check(self.lib.inflateSetDictionary(ctypes.byref(self.s), window, len(window)))

    def feed(self, data: bytes) -> None:
        self.data = data  # zlib reads from it
        self.s.next_in, self.s.avail_in = ctypes.cast(ctypes.c_char_p(data), ctypes.c_void_p), len(data)

    def step(self, flush: int) -> tuple[int, bytes]:
        self.s.next_out, self.s.avail_out = ctypes.addressof(self.out), _OUT
        result = self._check(self.lib.inflate(ctypes.byref(self.s), flush))
        return result, ctypes.string_at(self.out, _OUT - self.s.avail_out)

    def again(self) -> None:
        """For the next of several gzip members."""
        self._check(self.lib.inflateReset(ctypes.byref(self.s)))

    def close(self) -> None:
        self.lib.inflateEnd(ctypes.byref(self.s))


def unpack(path: str, points: str, every: int) -> Iterator[tuple[int, bytes]]:
    """The unpacked file, each chunk with the number of the point that it begins at, or -1; the points, `every` bytes apart or more, are written to `points`."""
    system, inner = file_system(path)
    to, target = file_system(points)
    to.create_dir(os.path.dirname(target), recursive=True)
    with system.open_input_stream(inner, compression=None) as f, to.open_output_stream(target, compression=None) as slots:
        z, window, number, since, begun = _Inflater(31), b"", 0, 0, 0
        slots.write(_HEAD.pack(0, 0, 0) + bytes(_WINDOW))
        at = 0  # of the file, behind what was fed
        more = f.read(_IN)
        try:
            while more:
                z.feed(more)
                at += len(more)
                while True:
                    result, data = z.step(_TO_BLOCK)
                    if data:
                        yield begun, data
                        begun, since = -1, since + len(data)
                        window = (window + data)[-_WINDOW:] if len(data) < _WINDOW else data[-_WINDOW:]
                    if result == _END:
                        z.again()
                        rest = z.data[len(z.data) - z.s.avail_in :]
                        if not rest.lstrip(b"\0") and not (rest := f.read(_IN)):
                            return
                        at += 0 if z.s.avail_in else len(rest)
                        z.feed(rest)
                    elif since >= every and z.s.data_type & 128 and not z.s.data_type & 64:
                        number, since = number + 1, 0
                        begun = number
                        slots.write(_HEAD.pack(at - z.s.avail_in, z.s.data_type & 7, len(window)) + window.ljust(_WINDOW, b"\0"))
                    elif not z.s.avail_in and not data:
                        break
                more = f.read(_IN)
        finally:
            z.close()


def resumed(path: str, points: str, number: int) -> Iterator[bytes]:
    """What the file has from a point on."""
    system, inner = file_system(path)
    with system.open_input_file(inner) as f:
        if not number:
            yield from _members(f, b"")
            return
        to, target = file_system(points)
        with to.open_input_file(target) as slots:
            slots.seek(number * SLOT)
            at, bits, size = _HEAD.unpack(slots.read(_HEAD.size))
            window = slots.read(size)
        f.seek(at - bool(bits))
        z = _Inflater(-15)
        try:
            z.resume(bits, f.read(1)[0] if bits else 0, window)
            while more := f.read(_IN):
                z.feed(more)
                while True:
                    result, data = z.step(_NO_FLUSH)
                    if data:
                        yield data
                    if result == _END:
                        rest = z.data[len(z.data) - z.s.avail_in :]
                        rest += f.read(max(8 - len(rest), 0))
                        yield from _members(f, rest[8:])  # the end of a member is 8 bytes
                        return
                    if not z.s.avail_in and not data:
                        break
        finally:
            z.close()


def _members(f, rest: bytes) -> Iterator[bytes]:
    """The members that begin with `rest` and go on in f."""
    while True:
        rest = rest.lstrip(b"\0") or f.read(_IN).lstrip(b"\0")
        if not rest:
            return
        z = zlib.decompressobj(31)
        while not z.eof and rest:
            data = z.decompress(rest, _OUT)
            if data:
                yield data
            rest = z.unconsumed_tail or (b"" if z.eof else f.read(_IN))
        rest = z.unused_data
