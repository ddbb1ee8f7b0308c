"""BAM, the packed form of alignments: a Spark data source with splits, pushed regions, and a sink that writes its index.

A file is cut at bounds of compressed blocks. With an index (.bai) the bounds are records' starts that it knows, and a
filter on sequence and position reads only the chunks of the index's bins that can hold such reads. Without one, each
split looks for its first record by the layout of several that follow one another, and checks that the next split found
the very record that follows its own last one, so a wrong guess is an error and never a wrong row. Records are decoded
in batches, by columns. A folder of files is read as one table; the sequences are those of the first file's header.

Cases: unmapped reads have seq `*`; missing names, bases and qualities are `*`; a read without a group has rg null; CIGARs
of more than 65,535 operations are taken from their tag.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import bgzf

READ = "name string, flag int, seq string, pos long, mapq int, cigar array<struct<op: int, len: int>>, mate_seq string, mate_pos long, tlen long, bases string, qual string, rg string, ref_end long, rlen int"
#: Letters of packed bases by their code, and the codes of operations that move on in the reference.
LETTERS, MOVES = "=ACMGRSVTWYHKDBN", (0, 2, 3, 7, 8)
#: Compressed bytes of a split.
SPLIT = 32 << 20
#: Reads of a file, about: a task sorts them.
FILE = 1 << 19
#: Fixed values of the index: a leaf bin's width, the first bin of each level, the pseudo-bin of counts, a window's width.
LEAF, LEVELS, PSEUDO, WINDOW = 14, (4681, 585, 73, 9, 1, 0), 37450, 1 << 14
_PAIRS = np.frombuffer("".join(a + b for a in LETTERS for b in LETTERS).encode(), np.uint8).reshape(256, 2)


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    for k, first in enumerate(LEVELS):
        if start >> (LEAF + 3 * k) == (end - 1) >> (LEAF + 3 * k):
            return first + (start >> (LEAF + 3 * k))
    return 0


def bins_over(start: int, end: int) -> set[int]:
    """All bins that can hold something in [start, end)."""
    end = min(end, 1 << 29)
    return {b for k, first in enumerate(LEVELS) for b in range(first + (start >> (LEAF + 3 * k)), first + ((end - 1) >> (LEAF + 3 * k)) + 1)} if start < end else set()


@dataclass
class Header:
    text: str
    names: list[str]
    lengths: list[int]
    first: int  # virtual place of the first record


def header(path: str) -> Header:
    blocks = bgzf.Blocks(path, 0)

    def take(at, n):
        if not blocks.has(at, n):
            raise ValueError(f"{path} ends in its header")
        return blocks.get(at, n)

    if take(0, 4) != b"BAM\1":
        raise ValueError(f"{path} isn't a BAM file")
    n = struct.unpack("<i", take(4, 4))[0]
    text = take(8, n).split(b"\0")[0].decode()
    count, at, names, lengths = struct.unpack("<i", take(8 + n, 4))[0], 12 + n, [], []
    for _ in range(count):
        size = struct.unpack("<i", take(at, 4))[0]
        name = take(at + 4, size + 4)
        names.append(name[: size - 1].decode())
        lengths.append(struct.unpack("<i", name[size:])[0])
        at += 8 + size
    return Header(text, names, lengths, blocks.virtual(at) if at < len(blocks.data) else blocks.next << 16)


def index(path: str) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]] | None:
    """For each sequence the chunks of its bins and the first places of its windows; None without an index file."""
    try:
        file, size = bgzf.open_file(path + ".bai")
    except (FileNotFoundError, OSError):
        return None
    raw = file.read(size)
    if raw[:4] != b"BAI\1":
        raise ValueError(f"{path}.bai isn't an index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        bins = {}
        (n,), at = struct.unpack_from("<i", raw, at), at + 4
        for _ in range(n):
            b, chunks = struct.unpack_from("<Ii", raw, at)
            flat = struct.unpack_from(f"<{2 * chunks}Q", raw, at + 8)
            at += 8 + 16 * chunks
            if b != PSEUDO:
                bins[b] = list(zip(flat[::2], flat[1::2], strict=True))
        (n,), at = struct.unpack_from("<i", raw, at), at + 4
        out.append((bins, list(struct.unpack_from(f"<{n}Q", raw, at))))
        at += 8 * n
    return out


def chunks_of(found, start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of virtual places that hold all reads over [start, end) of a sequence, joined where they touch."""
    bins, windows = found
    least = windows[min(start // WINDOW, len(windows) - 1)] if windows else 0
    out: list[tuple[int, int]] = []
    for a, z in sorted(c for b in bins_over(start, end) for c in bins.get(b, ()) if c[1] > least):
        a = max(a, least)
        if out and a >> 16 <= out[-1][1] >> 16:
            out[-1] = out[-1][0], max(out[-1][1], z)
        else:
            out.append((a, z))
    return out


@dataclass
class Split(InputPartition):
    """Records from a virtual place on, up to one. Without a start: from the first one in a block at `after` or later, up to the first one at `before` or later."""

    path: str
    start: int | None = None
    end: int | None = None
    after: int = 0
    before: int | None = None


class BamReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.seqs: set[str] | None = None
        self.low, self.high = 0, 1 << 40

    def pushFilters(self, filters):
        """Region filters choose what is read; Spark applies all filters again to the rows."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("seq",) and isinstance(f, (EqualTo, In)):
                named = {value} if isinstance(f, EqualTo) else set(value)
                self.seqs = named if self.seqs is None else self.seqs & named
            elif column in (("pos",), ("ref_end",)) and isinstance(value, int):
                if column == ("pos",) and isinstance(f, LessThan):
                    self.high = min(self.high, value)
                elif column == ("pos",) and isinstance(f, LessThanOrEqual):
                    self.high = min(self.high, value + 1)
                elif isinstance(f, GreaterThan):  # a read that ends, or begins, after value covers a place from there on
                    self.low = max(self.low, value)
                elif isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, value - (column == ("ref_end",)))
            yield f

    def partitions(self) -> Sequence[Split]:
        return [s for path in bgzf.list_files(self.path, ".bam") for s in self._splits(path)]

    def _splits(self, path: str) -> Iterator[Split]:
        head, found = header(path), index(path)
        _, size = bgzf.open_file(path)
        if found is None:
            first = head.first >> 16
            cuts = [*range(first, size, self.size)]
            for k, cut in enumerate(cuts):
                yield Split(path, head.first if k == 0 else None, None, cut, cuts[k + 1] if k + 1 < len(cuts) else None)
            return
        if self.seqs is not None and "*" not in self.seqs:
            for k in sorted(head.names.index(s) for s in self.seqs if s in head.names):
                for a, z in chunks_of(found[k], max(self.low, 0), min(self.high, head.lengths[k] + 1)):
                    yield from self._cut(path, a, z, found)
        else:
            yield from self._cut(path, head.first, size << 16, found)

    def _cut(self, path: str, start: int, end: int, found) -> Iterator[Split]:
        """The stretch in splits: bounds are places of records that the index has."""
        known = sorted({c[0] for bins, _ in found for chunks in bins.values() for c in chunks} | {w for _, windows in found for w in windows if w})
        at = start
        for place in known:
            if start < place < end and (place >> 16) - (at >> 16) >= self.size:
                yield Split(path, at, place)
                at = place
        yield Split(path, at, end)

    def read(self, split: Split | None):
        if split is None:  # nothing in the region
            return
        head = header(split.path)
        lengths = np.array(head.lengths, np.int64)
        start = split.start
        if start is None:
            start = bgzf.first_record(split.path, split.after, lengths)
        until = split.end
        if until is None and split.before is not None:
            until = bgzf.first_record(split.path, split.before, lengths)
        if start is not None and (until is None or start < until):
            yield from records(split.path, start, until, head, checked=split.end is None)


def records(path: str, start: int, until: int | None, head: Header, checked: bool = False, batch_bytes: int = 4 << 20):
    """Record batches of what begins at start or later and before `until`. checked: a record must begin at `until`.

    A step a record is to read its length; blocks after that of `until` are read only for a record that goes on in them.
    """
    blocks = bgzf.Blocks(path, start >> 16)
    at, stop, done, length = start & 0xFFFF, None, False, struct.Struct("<i").unpack_from
    first, places, sizes = at, [], []
    while not done:
        while (until is None or blocks.next <= until >> 16) and blocks.end() < first + batch_bytes and blocks.more():
            pass
        if until is not None and stop is None and blocks.next > until >> 16:
            stop = blocks.position(until)
        data, base, end = blocks.data, blocks.dropped, blocks.end()
        last = end - 4 if stop is None else min(end - 4, stop - 1)
        while at <= last and at - first < batch_bytes:
            (size,) = length(data, at - base)
            if size < 32:
                raise ValueError(f"{path}: broken record at {blocks.virtual(at)}")
            if at + 4 + size > end:
                break
            places.append(at + 4)
            sizes.append(size)
            at += 4 + size
        if stop is not None and at >= stop:
            if checked and at != stop:
                raise ValueError(f"{path}: {until} isn't a record's start; write an index to split it")
            done = True
        elif at - first < batch_bytes:
            if not blocks.has(at, 4):
                if checked and until is not None:
                    raise ValueError(f"{path}: no record begins at {until}; write an index to split it")
                done = True
            elif not blocks.has(at + 4, length(blocks.data, at - blocks.dropped)[0]):
                raise ValueError(f"{path}: broken record at {blocks.virtual(at)}")
        if places and (done or at - first >= batch_bytes):
            yield decode(np.frombuffer(blocks.get(first, at - first), np.uint8), np.array(places, np.int64) - first, np.array(sizes, np.int64), head)
            places, sizes = [], []
            blocks.drop(at)
            first = at


def _ragged(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of stretches one after another, and where each of them begins."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return raw[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], counts)], offsets


def _strings(raw: np.ndarray, offsets: np.ndarray):
    import pyarrow as pa

    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))).cast(pa.string())


#: Bytes of a tag's value by its type.
_TAG = {c: n for kind, n in (("AcC", 1), ("sS", 2), ("iIf", 4), ("d", 8)) for c in kind.encode()}


def _tag(raw: bytes, at: int, end: int, wanted: bytes) -> tuple[int, int, int] | None:
    """Type, start and end of a tag's value."""
    while at + 3 <= end:
        name, kind = raw[at : at + 2], raw[at + 2]
        at += 3
        if kind in b"ZH":
            stop = raw.index(0, at, end)
            size = stop + 1 - at
        elif kind == 66:  # an array: a type, a count and values
            size = 5 + _TAG[raw[at]] * struct.unpack_from("<I", raw, at + 1)[0]
        else:
            size = _TAG[kind]
        if name == wanted:
            return kind, at, at + size
        at += size
    return None


def _groups(raw: np.ndarray, at: np.ndarray, ends: np.ndarray):
    """Values of the tag RG. Where it is the first tag, or there is none, without a step a record."""
    import pyarrow as pa

    some = np.flatnonzero(ends - at > 3)
    first = some[(raw[at[some, None] + np.arange(3)] == np.frombuffer(b"RGZ", np.uint8)).all(1)]
    zeros = np.flatnonzero(raw == 0)
    counts, given = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    stops = np.append(zeros, len(raw))[np.searchsorted(zeros, at[first] + 3)]
    first, stops = first[stops < ends[first]], stops[stops < ends[first]]
    counts[first], given[first] = stops - at[first] - 3, True
    letters, offsets = _ragged(raw, at + 3, counts)
    out = pa.compute.if_else(pa.array(given), _strings(letters, offsets), None)
    rest = np.flatnonzero(~given & (ends > at))
    if not len(rest):
        return out
    whole = raw.tobytes()
    found = [whole[t[1] : t[2] - 1].decode() if (t := _tag(whole, a, z, b"RG")) else None for a, z in zip(at[rest].tolist(), ends[rest].tolist(), strict=True)]
    return pa.compute.replace_with_mask(out, pa.array(~given & (ends > at)), pa.array(found, pa.string()))


def decode(raw: np.ndarray, at: np.ndarray, size: np.ndarray, head: Header):
    """Columns of the records that begin at `at`."""
    import pyarrow as pa

    f = raw[at[:, None] + np.arange(32)].view(bgzf.FIXED).ravel()
    name_at, ops, bases = at + 32, f["ops"].astype(np.int64), f["bases"].astype(np.int64)
    cigar_at = name_at + f["name"]
    packed_at = cigar_at + 4 * ops
    qual_at = packed_at + (bases + 1) // 2
    tags_at, ends = qual_at + bases, at + size

    names = pa.array([*head.names, "*"])
    seq, mate = (names.take(pa.array(np.where(f[c] < 0, len(head.names), f[c]))) for c in ("ref", "mate_ref"))
    words, offsets = _ragged(raw, cigar_at, 4 * ops)
    codes, offsets = words.view("<u4") if len(words) else np.empty(0, np.uint32), offsets // 4
    hidden = np.flatnonzero((ops == 2) & (bases > 0))
    whole = raw.tobytes() if len(hidden) else b""
    for k in hidden[(codes[offsets[hidden]] == (bases[hidden] << 4 | 4)) & (codes[offsets[hidden] + 1] & 15 == 3)][::-1].tolist():
        if found := _tag(whole, int(tags_at[k]), int(ends[k]), b"CG"):  # the true operations stand in a tag
            true = np.frombuffer(whole[found[1] + 5 : found[2]], "<u4")
            codes = np.concatenate([codes[: offsets[k]], true, codes[offsets[k + 1] :]])
            offsets = np.concatenate([offsets[: k + 1], offsets[k + 1 :] + len(true) - 2])
    ops = np.diff(offsets)
    op, n = (codes & 15).astype(np.int32), (codes >> 4).astype(np.int32)
    moved = np.concatenate([[0], np.cumsum(np.where(np.isin(op, MOVES), n, 0).astype(np.int64))])
    pos, mapped = f["pos"].astype(np.int64), (f["ref"] >= 0) & (ops > 0)
    none = ops == 0
    cigar = pa.ListArray.from_arrays(pa.array(np.where(np.append(none, False), 0, offsets), pa.int32(), mask=np.append(none, False)), pa.StructArray.from_arrays([pa.array(op), pa.array(n)], ["op", "len"])) if len(op) else pa.array([None] * len(at), pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())])))

    packed, packed_offsets = _ragged(raw, packed_at, (bases + 1) // 2)
    letters, letter_offsets = _ragged(_PAIRS[packed].ravel(), 2 * packed_offsets[:-1], bases)
    star = pa.array(bases == 0)
    text = pa.compute.if_else(star, "*", _strings(letters, letter_offsets))
    missing = bases == 0
    missing[~missing] |= raw[qual_at[~missing]] == 255
    quals, qual_offsets = _ragged(raw, qual_at, np.where(missing, 0, bases))
    quality = pa.compute.if_else(pa.array(missing), "*", _strings(np.where(quals == 255, 0, quals) + 33, qual_offsets))
    name, name_offsets = _ragged(raw, name_at, f["name"].astype(np.int64) - 1)
    return pa.RecordBatch.from_arrays(
        [
            _strings(name, name_offsets), pa.array(f["flag"].astype(np.int32)), seq, pa.array(pos), pa.array(f["mapq"].astype(np.int32)), cigar, mate, pa.array(f["mate_pos"].astype(np.int64)),
            pa.array(f["tlen"].astype(np.int64)), text, quality, _groups(raw, tags_at, ends), pa.array(pos + moved[offsets[1:]] - moved[offsets[:-1]], mask=~mapped), pa.array(bases.astype(np.int32)),
        ],
        names=[x.split()[0] for x in READ.replace("array<struct<op: int, len: int>>", "x").split(", ")],
    )


#: The code of each letter as a hexadecimal digit; what is no letter is 15, N.
_DIGITS = bytes((b"%x" % (LETTERS.index(chr(c)) if chr(c) in LETTERS else 15))[0] for c in range(256))


def encode(row: dict, numbers: dict[str, int]) -> bytes:
    """A record, with its length. row: the columns of a read; numbers: of the sequences."""
    ref = numbers.get(row["seq"], -1)
    mate = ref if row["mate_seq"] == "=" else numbers.get(row["mate_seq"], -1)
    cigar = [c["len"] << 4 | c["op"] for c in row["cigar"] or ()]
    covers = sum(c["len"] for c in row["cigar"] or () if c["op"] in MOVES)
    bases = "" if row["bases"] in (None, "*") else row["bases"]
    tags = b"" if row["rg"] is None else b"RGZ" + row["rg"].encode() + b"\0"
    if len(cigar) > 0xFFFF:
        tags += b"CGBI" + struct.pack(f"<I{len(cigar)}I", len(cigar), *cigar)
        cigar = [len(bases) << 4 | 4, covers << 4 | 3]
    codes = bases.upper().encode("ascii", "replace").translate(_DIGITS)
    packed = bytes.fromhex((codes + b"0" * (len(codes) % 2)).decode())
    qual = b"\xff" * len(bases)
    if row["qual"] not in (None, "*"):
        each = np.frombuffer(row["qual"].encode("latin-1"), np.uint8)
        if each.min(initial=33) < 33:
            raise ValueError(f"{row['name']}: base qualities begin at !")
        qual = (each - np.uint8(33)).tobytes()
    name = (row["name"] or "*").encode() + b"\0"
    pos = -1 if row["pos"] is None else row["pos"]
    fixed = struct.pack("<iiBBHHHiiii", ref, pos, len(name), row["mapq"] or 0, bin_of(max(pos, 0), max(pos, 0) + max(covers, 1)) & 0xFFFF, len(cigar), row["flag"] or 0, len(bases), mate, -1 if row["mate_pos"] is None else row["mate_pos"], row["tlen"] or 0)
    body = fixed + name + struct.pack(f"<{len(cigar)}I", *cigar) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


_CODES = np.frombuffer(bytes(int(chr(c), 16) for c in _DIGITS), np.uint8)
#: The code of each byte of bases, small letters as large ones.
_CODES = _CODES[np.frombuffer(bytes(range(256)).upper(), np.uint8)]
_MOVING = np.isin(np.arange(16), MOVES)


def _letters(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after another, and the number of each; null has none."""
    import pyarrow as pa

    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def _holding(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows that have one of the marked bytes; counts: bytes of each row."""
    return np.searchsorted(np.cumsum(counts), np.flatnonzero(found), "right")


def _put(out: np.ndarray, raw: np.ndarray, at: np.ndarray, counts: np.ndarray) -> None:
    """Stretches that follow one another in raw, each to its place."""
    out[np.arange(len(raw)) + np.repeat(at - np.cumsum(counts) + counts, counts)] = raw


def _bins(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """bin_of() of each."""
    out = np.zeros(len(start), np.int64)
    for k, first in reversed(list(enumerate(LEVELS))):
        own = start >> (LEAF + 3 * k)
        out = np.where(own == (end - 1) >> (LEAF + 3 * k), first + own, out)
    return out


def encode_batch(batch, names: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The records of a batch as encode() makes them, one after another; their lengths, sequences, starts and ends.

    Sequences are -1 where a read has no place. Rows with letters outside ASCII, with figures that a record can't hold
    as they are, or of more operations than that, go through encode().
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    rows, known = len(batch), pa.array(names, pa.string())
    column = lambda c: batch.column(c)
    figure = lambda c, none=0: pc.fill_null(column(c).cast(pa.int64()), none).to_numpy(zero_copy_only=False)
    number = lambda c: pc.fill_null(pc.index_in(column(c).cast(pa.string()), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    without_star = lambda c: pc.if_else(pc.equal(column(c), "*"), "", column(c))
    ref, pos = number("seq"), figure("pos", -1)
    mate = np.where(pc.fill_null(pc.equal(column("mate_seq"), "="), False).to_numpy(zero_copy_only=False), ref, number("mate_seq"))
    ops = pc.fill_null(pc.list_value_length(column("cigar")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column("cigar").flatten()
    op, length = (pc.fill_null(pc.struct_field(flat, c).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for c in ("op", "len"))
    sums = np.concatenate([[0], np.cumsum(np.where(_MOVING[op & 15], length, 0))])
    ends = np.cumsum(ops)
    covers = sums[ends] - sums[ends - ops]
    name, name_n = _letters(pc.if_else(pc.equal(pc.fill_null(column("name"), ""), ""), "*", column("name")))
    bases, bases_n = _letters(without_star("bases"))
    qual, qual_n = _letters(without_star("qual"))
    group, group_n = _letters(column("rg"))
    grouped = column("rg").is_valid().to_numpy(zero_copy_only=False)
    has_qual = pc.fill_null(pc.not_equal(column("qual"), "*"), False).to_numpy(zero_copy_only=False)
    flag, mapq, mate_pos, tlen = figure("flag"), figure("mapq"), figure("mate_pos", -1), figure("tlen")

    where = np.where((ref >= 0) & (pos >= 0), ref, -1), pos, pos + np.maximum(covers, 1)
    outside = lambda x, low, high: (x < low) | (x >= high)
    odd = (ops > 0xFFFF) | (has_qual & (qual_n != bases_n)) | outside(flag, 0, 1 << 16) | outside(mapq, 0, 1 << 8) | (name_n > 254)
    odd |= outside(pos, -(1 << 31), 1 << 31) | outside(mate_pos, -(1 << 31), 1 << 31) | outside(tlen, -(1 << 31), 1 << 31)
    odd[_holding(bases > 127, bases_n)] = odd[_holding((qual > 127) | (qual < 33), qual_n)] = odd[_holding(outside(length, 0, 1 << 28) | outside(op, 0, 16), ops)] = True
    if odd.any():
        numbers = {n: k for k, n in enumerate(names)}
        plain, plain_size, *_ = encode_batch(batch.filter(pa.array(~odd)), names)
        size = np.zeros(rows, np.int64)
        size[~odd] = plain_size
        parts, last = [], 0
        for k, cut in zip(np.flatnonzero(odd).tolist(), np.cumsum(size)[odd].tolist(), strict=True):
            one = encode(batch.slice(k, 1).to_pylist()[0], numbers)
            parts += plain[last:cut], one
            size[k], last = len(one), cut
        return b"".join([*parts, plain[last:]]), size, *where

    half = (bases_n + 1) // 2
    name_at = 36
    tags = np.where(grouped, group_n + 4, 0)
    size = name_at + name_n + 1 + 4 * ops + half + bases_n + tags
    at = np.cumsum(size) - size
    fixed = np.zeros(rows, [("size", "<i4"), *((c, bgzf.FIXED[c].str) for c in bgzf.FIXED.names)])
    start = np.maximum(pos, 0)
    values = (size - 4, ref, pos, name_n + 1, mapq, _bins(start, start + np.maximum(covers, 1)) & 0xFFFF, ops, flag, bases_n, mate, mate_pos, tlen)
    for c, v in zip(fixed.dtype.names, values, strict=True):
        fixed[c] = v
    out = np.full(int(size.sum()), 255, np.uint8)  # what has no qualities has 255 for each base
    out[at[:, None] + np.arange(name_at)] = fixed.view(np.uint8).reshape(rows, name_at)
    _put(out, name, at + name_at, name_n)
    to = at + name_at + name_n
    out[to] = 0
    _put(out, (length << 4 | op).astype("<u4").view(np.uint8), to + 1, 4 * ops)
    to = to + 1 + 4 * ops
    even = np.zeros(2 * int(half.sum()), np.uint8)
    _put(even, _CODES[bases], 2 * (np.cumsum(half) - half), bases_n)
    _put(out, even[::2] << 4 | even[1::2], to, half)
    to = to + half
    _put(out, qual - np.uint8(33), to, qual_n)
    to = (to + bases_n)[grouped]
    out[to[:, None] + np.arange(3)] = np.frombuffer(b"RGZ", np.uint8)
    _put(out, group, to + 3, group_n[grouped])
    out[to + 3 + group_n[grouped]] = 0
    return out.tobytes(), size, *where


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class BamWriter(DataSourceArrowWriter):
    """Each task writes a whole file with its index; names are of the attempt until all are done."""

    def __init__(self, options: dict):
        self.path, self.text = options["path"], options["header"]
        sq = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in self.text.splitlines() if line.startswith("@SQ")]
        self.names, self.lengths, self.block = [x["SN"] for x in sq], [int(x["LN"]) for x in sq], int(options.get("block", 60_000))

    def write(self, iterator):
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        target = f"{folder.rstrip('/')}/_part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.bam"
        text = self.text.encode()
        start = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.names)) + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", n_) for n, n_ in zip(self.names, self.lengths, strict=True))
        bins, windows, none = [defaultdict(list) for _ in self.names], [{} for _ in self.names], 0
        place, held, made = 0, bytearray(), 0  # made: bytes of records so far
        places: list[int] = []  # of blocks with records; all but the last hold self.block bytes
        runs = []  # sequences, bins, first and last bytes of records of one bin that follow one another
        with system.open_output_stream(target) as out:

            def flush(least):
                nonlocal held, place
                at = 0
                while len(held) - at >= least:
                    block = bgzf.compress(bytes(held[at : at + self.block]))
                    out.write(block)
                    places.append(place)
                    place += len(block)
                    at += self.block
                del held[:at]

            for s in range(0, len(start), self.block):
                block = bgzf.compress(start[s : s + self.block])
                out.write(block)
                place += len(block)
            for batch in iterator:
                if not len(batch):
                    continue
                raw, sizes, ref, first, end = encode_batch(batch, self.names)
                after = made + np.cumsum(sizes)
                at, made = after - sizes, int(after[-1])
                held += raw
                flush(self.block)
                placed = np.flatnonzero(ref >= 0)
                none += len(ref) - len(placed)
                leaf = np.where(ref >= 0, _bins(np.maximum(first, 0), end), -1)
                new = np.flatnonzero(np.concatenate([[True], (np.diff(ref) != 0) | (np.diff(leaf) != 0)]))
                runs.append(np.stack([ref[new], leaf[new], at[new], np.append(at[new[1:]], made)])[:, ref[new] >= 0])
                low = first[placed] // WINDOW
                over = (end[placed] - 1) // WINDOW - low + 1
                row = np.repeat(np.arange(len(placed)), over)
                window = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(over) - over, over)
                found, earliest = np.unique(ref[placed][row] << 32 | window, return_index=True)
                for w, r in zip(found.tolist(), at[placed][row[earliest]].tolist(), strict=True):
                    windows[w >> 32].setdefault(w & 0xFFFFFFFF, r)
            flush(1)
            out.write(bgzf.END)
        virtual = lambda at: place << 16 if at == made else places[at // self.block] << 16 | at % self.block
        for run in runs:
            for ref, leaf, at, after in run.T.tolist():
                chunks = bins[ref][leaf]
                if chunks and chunks[-1][1] == at:
                    chunks[-1] = chunks[-1][0], after
                else:
                    chunks.append((at, after))
        bins = [{k: [(virtual(a), virtual(z)) for a, z in chunks] for k, chunks in b.items()} for b in bins]
        windows = [{k: virtual(at) for k, at in w.items()} for w in windows]
        packed = b"BAI\1" + struct.pack("<i", len(self.names))
        for b, w in zip(bins, windows, strict=True):
            packed += struct.pack("<i", len(b)) + b"".join(struct.pack("<Ii", k, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for k, c in sorted(b.items()))
            n, seen = max(w, default=-1) + 1, 0
            packed += struct.pack("<i", n)
            for k in range(n):
                seen = w.get(k, seen)
                packed += struct.pack("<Q", seen)
        with system.open_output_stream(target + ".bai") as out:
            out.write(packed + struct.pack("<Q", none))
        return Written([target])

    def commit(self, messages):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for target in (f for m in messages if m for f in m.files):
            folder, name = target.rsplit("/", 1)
            for end in (".bai", ""):
                system.move(target + end, f"{folder}/{name[1:]}{end}")

    def abort(self, messages):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for target in (f for m in messages if m for f in m.files):
            for end in (".bai", ""):
                system.delete_file(target + end)


class BamDataSource(DataSource):
    """Options: path (a file or a folder of files), split (compressed bytes of a partition); to write: header."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(dict(self.options))


def bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """All reads of a file or folder. Filters on seq, pos and ref_end with constants choose what is read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamDataSource)
    return spark.read.format("bam").option("split", split).load(path)


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """The header's lines (value), for sequence_dictionary() and read_groups()."""
    return spark.createDataFrame([(x,) for x in header(bgzf.list_files(path, ".bam")[0]).text.splitlines()], "value string")


def header_text(lengths: Sequence[tuple[str, int]], groups: Sequence[tuple[str, str]] = ()) -> str:
    return "".join(["@HD\tVN:1.6\tSO:coordinate\n", *(f"@SQ\tSN:{s}\tLN:{n}\n" for s, n in lengths), *(f"@RG\tID:{g}\tSM:{s}\n" for g, s in groups)])


def write_bam(reads: DataFrame, path: str, text: str, partitions: int | None = None) -> None:
    """A folder of sorted files with their indexes. reads: the columns of bam(); others are made or ignored.

    Reads are dealt out by ranges of the sequence's place in the header and the position, so each file is sorted. The
    ranges' bounds are quantiles of these two alone: no other column of the reads is made to find them. Without
    `partitions` there are as many files as shuffle partitions, or more for more than FILE reads a file. `text` is the
    header; its sequences are a bounded list.
    """
    from pyspark.ml.feature import Bucketizer  # not for tasks, which import this module

    spark = reads.sparkSession
    spark.dataSource.register(BamDataSource)
    names = [x.split("\t")[1][3:] for x in text.splitlines() if x.startswith("@SQ")]
    order = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("seq")), F.lit(0)) if names else F.lit(0)
    kinds = {x.split()[0]: x.split(" ", 1)[1] for x in READ.replace("array<struct<op: int, len: int>>", "array<struct<op:int,len:int>>").split(", ")}
    row = reads.select(*((F.col(c) if c in reads.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
    placed = row.withColumn("_order", F.when(order == 0, len(names) + 1).otherwise(order))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = placed.withColumn("_at", (F.col("_order") * (1 << 32) + F.coalesce("pos", F.lit(-1)) + 1).cast("double"))
    count, sketch = keyed.agg(F.count("*"), F.kll_sketch_agg_double("_at", min(65535, max(2048, 10 * n)))).first()
    n, found = partitions or max(n, count // FILE), ()
    if count and n > 1:
        shares = F.array(*(F.lit(k / n) for k in range(1, n)))
        found = spark.createDataFrame([(bytes(sketch),)], "s binary").select(F.kll_sketch_get_quantile_double("s", shares)).first()[0]  # a figure for each file
    bounds = [-math.inf, *sorted(set(found)), math.inf]
    if len(bounds) > 2:
        keyed = Bucketizer(splits=bounds, inputCol="_at", outputCol="_file").transform(keyed)
    else:
        keyed = keyed.withColumn("_file", F.lit(0))
    dealt = keyed.repartitionById(len(bounds) - 1, F.col("_file").cast("int")).sortWithinPartitions("_order", "pos", "name").select(*kinds)
    dealt.write.format("bam").mode("append").option("header", text).save(path)
