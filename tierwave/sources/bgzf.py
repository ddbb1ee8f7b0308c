"""Blocked gzip: positions in it, blocks from a place on, and the record starts of a file of alignments."""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np

#: The first bytes of a block, the longest block, and the empty block that ends a file.
MAGIC = b"\x1f\x8b\x08\x04"
MAX_BLOCK = 1 << 16
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Fixed part of a record, without its length.
FIXED = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
#: Records that must follow one another for a place to count as a record's start.
CHAIN = 8


def open_file(path: str):
    """A random-access file and its length, on any file system that Arrow knows."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name), system.get_file_info(name).size


def list_files(path: str, ending: str) -> list[str]:
    """path itself, or the files of a folder with that ending, by name."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    info = system.get_file_info(name)
    if info.type != fs.FileType.Directory:
        return [path]
    prefix = path[: len(path) - len(name)] if path.endswith(name) else path.rstrip("/").removesuffix(name.rstrip("/"))
    return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(name)) if f.path.endswith(ending) and not f.base_name.startswith(("_", ".")))


def block_length(head: bytes, at: int = 0) -> int:
    """Bytes of the block that begins at `at`; 0 if none does."""
    if head[at : at + 4] != MAGIC or len(head) < at + 18:
        return 0
    (extra,) = struct.unpack_from("<H", head, at + 10)
    k, end = at + 12, at + 12 + extra
    while k + 4 <= end and k + 6 <= len(head):
        kind, n = head[k : k + 2], struct.unpack_from("<H", head, k + 2)[0]
        if kind == b"BC" and n == 2:
            return struct.unpack_from("<H", head, k + 4)[0] + 1
        k += 4 + n
    return 0


def compress(data: bytes, level: int = 6) -> bytes:
    """One block of up to 64,000 bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<4sIBBHBBHH", MAGIC, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Blocks:
    """The bytes of blocks from a place in the file on, read as they are asked for; `start` is a block's place."""

    def __init__(self, path: str, start: int, step: int = 1 << 20):
        self.file, self.size = open_file(path)
        self.raw, self.raw_at, self.step = b"", start, step
        self.next = start  # place of the next block
        self.data = bytearray()
        self.dropped = 0  # bytes of data that are gone
        self.at, self.places = [], []  # where each block's data begins, and the block's place
        self.read = 0

    def _raw(self, n: int) -> bytes:
        """At least n bytes from self.next on, or all there are."""
        have = self.raw_at + len(self.raw) - self.next
        if have < n:
            keep = self.raw[self.next - self.raw_at :] if have > 0 else b""
            self.file.seek(self.next + len(keep))
            more = self.file.read(max(self.step, n - len(keep)))
            self.read += len(more)
            self.raw, self.raw_at = keep + more, self.next
        return self.raw[self.next - self.raw_at : self.next - self.raw_at + n]

    def more(self) -> bool:
        """Reads one more block; False at the file's end."""
        if self.next >= self.size:
            return False
        head = self._raw(512)
        n = block_length(head)
        if not n:
            raise ValueError(f"no block at {self.next}")
        raw = self._raw(n)
        data = zlib.decompressobj(-15)
        body = data.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0] : n - 8])
        if len(raw) < n or zlib.crc32(body) != struct.unpack_from("<I", raw, n - 8)[0]:
            raise ValueError(f"broken block at {self.next}")
        if body:
            self.at.append(self.dropped + len(self.data))
            self.places.append(self.next)
            self.data += body
        self.next += n
        return True

    def has(self, start: int, n: int) -> bool:
        """Reads until n bytes from position `start` on are there."""
        while self.dropped + len(self.data) < start + n:
            if not self.more():
                return False
        return True

    def get(self, start: int, n: int) -> bytes:
        return bytes(self.data[start - self.dropped : start - self.dropped + n])

    def drop(self, before: int) -> None:
        k = bisect.bisect_right(self.at, before) - 1
        if k > 0:
            del self.data[: self.at[k] - self.dropped]
            self.dropped = self.at[k]
            del self.at[:k], self.places[:k]

    def end(self) -> int:
        """Position after the last byte that is there."""
        return self.dropped + len(self.data)

    def position(self, virtual: int) -> int:
        """Position of a virtual place, whose block must have been read: where it or what follows begins."""
        k = bisect.bisect_left(self.places, virtual >> 16)
        if k == len(self.places):
            return self.end()
        return self.at[k] + (virtual & 0xFFFF if self.places[k] == virtual >> 16 else 0)

    def virtual(self, position: int) -> int:
        """Place of a position: the block's, and where in it, as one number."""
        k = bisect.bisect_right(self.at, position) - 1
        return self.places[k] << 16 | position - self.at[k]


def first_block(path: str, after: int) -> int | None:
    """Place of the first block that begins at `after` or later: two more follow it, or the file's end."""
    file, size = open_file(path)
    while after < size:
        file.seek(after)
        window = file.read(4 * MAX_BLOCK)
        at = window.find(MAGIC)
        while 0 <= at < MAX_BLOCK:
            ends, good = at, True
            for _ in range(3):
                n = block_length(window, ends)
                ends += n
                if not n or after + ends > size:
                    good = False
                    break
                if after + ends == size:
                    break
            if good:
                return after + at
            at = window.find(MAGIC, at + 1)
        after += MAX_BLOCK
    return None


def first_record(path: str, after: int, lengths: np.ndarray) -> int | None:
    """Virtual place of the first record that begins in a block from `after` on; None if there is none.

    A record is told by the fields that its layout fixes, in it and in those that follow. lengths: of the sequences.
    """
    place = first_block(path, after)
    if place is None:
        return None
    blocks, start = Blocks(path, place), 0

    def possible(at: int, end: int | None = None) -> np.ndarray:
        """Places from `at` on, 36 bytes of which are there (before `end`), where a record may begin."""
        raw = np.frombuffer(bytes(blocks.data[at:end]), np.uint8)
        n = len(raw) - 35
        if n <= 0:
            return np.empty(0, np.int64)
        word = lambda k: raw[k : k + n].astype(np.int32) | raw[k + 1 : k + 1 + n].astype(np.int32) << 8 | raw[k + 2 : k + 2 + n].astype(np.int32) << 16 | raw[k + 3 : k + 3 + n].astype(np.int32) << 24
        size, ref, pos, bases, mate, mate_pos = word(0), word(4), word(8), word(20), word(24), word(28)
        name, ops = raw[12 : 12 + n].astype(np.int64), raw[16 : 16 + n].astype(np.int64) | raw[17 : 17 + n].astype(np.int64) << 8
        longest = np.append(lengths, 0)
        fits = lambda r, p: (r >= -1) & (r < len(lengths)) & (p >= -1) & ((r < 0) | (p <= longest[np.clip(r, -1, len(lengths) - 1)]))
        least = 32 + name + 4 * ops + (bases.astype(np.int64) + 1) // 2 + bases
        return at + np.flatnonzero((size >= least) & (bases >= 0) & (name > 0) & fits(ref, pos) & fits(mate, mate_pos))

    def holds(at: int) -> bool:
        for _ in range(CHAIN):
            if not blocks.has(at, 36):
                return blocks.dropped + len(blocks.data) == at
            size, _, _, name = struct.unpack("<iiiB", blocks.get(at, 13))
            if not possible(at, at + 36).size or not blocks.has(at + 4, size) or blocks.get(at + 35 + name, 1) != b"\0":
                return False
            at += 4 + size
        return True

    while True:
        end = len(blocks.data)
        for at in possible(start).tolist():
            if holds(at):
                return blocks.virtual(at)
        start = max(start, end - 35)
        if len(blocks.data) == end and not blocks.more():
            return None
