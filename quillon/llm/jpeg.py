"""Media columns: baseline JPEG written and read in numpy.

The reader parses markers, Huffman-decodes the scan that holds the luminance,
alone or interleaved, and rebuilds the thumbnail that its DC terms give, one
sample for each 8 by 8 block. All restart segments of a batch are decoded in
step, one symbol of each at a time.

The writer stores bytes as such a thumbnail: with quantiser 8 the DC term of a
block is its mean less 128, so a grey image whose blocks are flat holds one
8-bit sample a block, without loss. Every row of blocks is a restart segment.
A payload beyond the format's height goes into several images end to end.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import common
from quillon.llm.common import Scratch

ROW = 576  # blocks in a row, and the unit payloads are padded to
MOST_ROWS = 65535 // 8
CHUNK = 1 << 21

# Lengths of the format's usual luminance DC codes, for categories 0 to 11 (fixed values).
DC_CODES_OF_LENGTH = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
# Flat blocks need one AC symbol, the end of block, as a one-bit code.
AC_CODES_OF_LENGTH = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int, width: int = ROW) -> bytes:
    """Everything of a grey image of flat blocks up to its scan data."""
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, bytes([0] + [8] * 64)),
        _segment(0xC0, bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * width).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _segment(0xC4, bytes([0x00, *DC_CODES_OF_LENGTH, *range(12)])),
        _segment(0xC4, bytes([0x10, *AC_CODES_OF_LENGTH, 0])),
        _segment(0xDD, width.to_bytes(2, "big")),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def huffman(counts, symbols) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16-bit window; length 0 is no code."""
    symbol, length, code, at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - size)
            symbol[first : first + (1 << (16 - size))] = symbols[at]
            length[first : first + (1 << (16 - size))] = size
            code, at = code + 1, at + 1
        code <<= 1
    return symbol, length


def _dc_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference from -255: code, value, end of block."""
    symbol, length = huffman(DC_CODES_OF_LENGTH, range(12))
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        window = int(np.flatnonzero((symbol == n) & (length > 0))[0])
        code = window >> (16 - int(length[window]))
        bits[d + 255] = ((code << n) | (d if d >= 0 else d + (1 << n) - 1)) << 1
        size[d + 255] = int(length[window]) + n + 1
    return bits, size


_BITS, _SIZE = _dc_codes()


def encode(samples: np.ndarray, rows_of: list[int]) -> list[bytes]:
    """One media value for each run of rows; samples has ROW bytes a row."""
    grid = samples.reshape(-1, ROW).astype(np.int64) - 128
    diff = np.diff(grid, axis=1, prepend=0) + 255
    bits, size = _BITS[diff], _SIZE[diff]
    ends = np.cumsum(size, axis=1)
    n_bytes = (ends[:, -1] + 7) // 8
    starts = np.concatenate(([0], np.cumsum(n_bytes)))
    at = (starts[:-1, None] * 8 + ends - size).ravel()
    word = bits.ravel() << (24 - size.ravel() - (at & 7))
    spot, total = at >> 3, int(starts[-1])
    scan = np.zeros(total + 2)
    for k, shift in enumerate((16, 8, 0)):
        scan += np.bincount(spot + k, (word >> shift) & 255, minlength=total + 2)[: total + 2]
    scan = scan[:total].astype(np.uint8)
    scan[starts[1:] - 1] |= ((1 << (n_bytes * 8 - ends[:, -1])) - 1).astype(np.uint8)
    full = np.flatnonzero(scan == 255)
    stuffed = np.insert(scan, full + 1, 0).tobytes()
    starts = (starts + np.searchsorted(full, starts)).tolist()
    out, row = [], 0
    for rows in rows_of:
        media = []
        for first in range(row, row + rows, MOST_ROWS):
            n = min(MOST_ROWS, row + rows - first)
            media.append(header(n))
            for k in range(n):
                if k:
                    media.append(bytes((0xFF, 0xD0 + (k - 1) % 8)))
                media.append(stuffed[starts[first + k] : starts[first + k + 1]])
            media.append(b"\xff\xd9")
        out.append(b"".join(media))
        row += rows
    return out


@dataclass
class Scan:
    """One scan, with the tables that hold when it starts, as unstuffed restart segments."""

    parts: list  # (component index, DC table, AC table)
    tables: dict  # class and id: the DHT's counts and symbols
    quant: dict
    interval: int
    segments: list = field(default_factory=list)


@dataclass
class Frame:
    """One image's header and its scans."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, h, v, quantiser table)
    scans: list = field(default_factory=list)

    def luminance(self) -> Scan:
        """The scan that holds the first component."""
        found = [s for s in self.scans if any(p[0] == 0 for p in s.parts)]
        if len(found) != 1:
            raise ValueError("the first component has no scan of its own, or several")
        return found[0]

    def layout(self):
        """Blocks of one MCU as (component index, dc, ac), MCUs across and down."""
        scan = self.luminance()
        h_most, v_most = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(scan.parts) == 1:
            _, h, v, _ = self.components[0]
            return scan.parts, -(-(-(-self.width * h // h_most)) // 8), -(-(-(-self.height * v // v_most)) // 8)
        blocks = [p for p in scan.parts for _ in range(self.components[p[0]][1] * self.components[p[0]][2])]
        return blocks, -(-self.width // (8 * h_most)), -(-self.height // (8 * v_most))

    def key(self):
        scan = self.luminance()
        return repr((self.components, scan.parts, sorted(scan.tables.items()), scan.interval))


_OTHER_FRAMES = (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)


def parse(media: bytes) -> list[Frame]:
    """The images in media, one after another. Raises ValueError on other formats and on images cut short."""
    frames, at = [], 0
    try:
        while at < len(media):
            frame, at = _parse_image(media, at)
            frames.append(frame)
    except (IndexError, KeyError) as e:
        raise ValueError("an image is cut short or refers to what it lacks") from e
    return frames


def _parse_image(media: bytes, at: int) -> tuple[Frame, int]:
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no image starts here")
    frame, quant, tables, interval, at = Frame(), {}, {}, 0, at + 2
    while True:
        if media[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            if not frame.scans:
                raise ValueError("an image has no scan")
            return frame, at + 2
        size = int.from_bytes(media[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(media):
            raise ValueError("a segment is cut short")
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                if wide > 1 or len(body) < 1 + 64 * (1 + wide):
                    raise ValueError("a quantiser table is cut short")
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("only 8-bit samples are read")
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            if not (frame.height and frame.width and frame.components and all(0 < c[1] < 5 and 0 < c[2] < 5 for c in frame.components)):
                raise ValueError("an image without rows, columns or components")
        elif marker in _OTHER_FRAMES:
            raise ValueError("only baseline images are read")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise ValueError("a code table is cut short")
                tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            index = {c[0]: k for k, c in enumerate(frame.components)}
            parts = [(index[body[1 + 2 * k]], body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15) for k in range(body[0])]
            scan = Scan(parts, {t: tables[t] for p in parts for t in p[1:]}, {frame.components[p[0]][3]: quant[frame.components[p[0]][3]] for p in parts}, interval)
            frame.scans.append(scan)
            start = at
            while True:
                at = media.find(b"\xff", at)
                if at < 0:
                    raise ValueError("a scan has no end")
                if media[at + 1] == 0:
                    at += 2
                    continue
                scan.segments.append(media[start:at].replace(b"\xff\x00", b"\xff"))
                if not 0xD0 <= media[at + 1] <= 0xD7:
                    break
                if media[at + 1] != 0xD0 + (len(scan.segments) - 1) % 8:
                    raise ValueError("a restart segment is missing")
                at += 2
                start = at


def decode_dc(frames: list[Frame]) -> list[np.ndarray]:
    """DC terms of the first component, in scan order, of like-keyed frames.

    Raises ValueError where bits are no code, a block has too many terms, or a
    restart segment has bits over or too few.
    """
    blocks, _, _ = frames[0].layout()
    scans = [f.luminance() for f in frames]
    lookups = {k: huffman(*t) for k, t in scans[0].tables.items()}
    wanted = [k for k, b in enumerate(blocks) if b[0] == 0]
    mcus, parts, owner = [], [], []
    for f, (frame, scan) in enumerate(zip(frames, scans)):
        _, across, down = frame.layout()
        left = across * down
        if len(scan.segments) != (-(-left // scan.interval) if scan.interval else 1):
            raise ValueError("a scan has other segments than its restart interval says")
        for part in scan.segments:
            n = min(left, scan.interval or left)
            mcus.append(n)
            parts.append(part)
            owner.append(f)
            left -= n
    mcus = np.array(mcus)
    sizes = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"".join(parts) + b"\xff" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    window = np.concatenate((window, np.full(64, 0xFFFFFFFF, np.uint32))).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(sizes)[:-1])) * 8
    order = np.argsort(-mcus, kind="stable")
    position, dc_start = start[order].copy(), np.cumsum([0, *(mcus * len(wanted))])
    end = (start + sizes * 8)[order]
    alive = np.searchsorted(-mcus[order], -np.arange(1, mcus.max(initial=0) + 1), side="right")
    found = np.zeros(int(dc_start[-1]), np.int64)
    pred = {b[0]: np.zeros(len(parts), np.int64) for b in blocks}
    put = dc_start[:-1][order].copy()
    bad = np.zeros(len(parts), bool)

    def peek(at):
        return (window[at >> 3] >> (16 - (at & 7))) & 0xFFFF

    def code(table, at):
        symbol, length = lookups[table]
        w = peek(at)
        return symbol[w], length[w]

    for m in range(len(alive)):
        n = int(alive[m])
        at = position[:n]
        for component, dc, ac in blocks:
            size, length = code(dc, at)
            bad[:n] |= (length == 0) | (size > 11)
            at += length
            value = peek(at) >> (16 - size)
            at += size
            value -= np.where((value << 1) < (1 << size), (1 << size) - 1, 0)
            now = pred[component]
            now[:n] += value
            if component == 0:
                found[put[:n]] = now[:n]
                put[:n] += 1
            s, length = code(ac, at)
            bad[:n] |= length == 0
            at += length + (s & 15)
            if s.any():  # more than ends of blocks
                coefficient = np.where(s == 0, 64, 1 + (s >> 4) + 1)
                bad[:n] |= (coefficient > 64) & (s != 0)
                go = np.flatnonzero(coefficient < 64)
                while len(go):
                    p = at[go]
                    s, length = code(ac, p)
                    bad[go] |= length == 0
                    at[go] = p + length + (s & 15)
                    coefficient[go] = np.where(s == 0, 64, coefficient[go] + (s >> 4) + 1)
                    bad[go] |= (coefficient[go] > 64) & (s != 0)
                    go = go[(coefficient[go] < 64) & (at[go] <= end[go])]
        bad[:n] |= at > end[:n]
        if bad.any():
            raise ValueError("a scan is corrupt")
    over = end - position  # the last byte's fill bits, all ones
    if (over > 7).any() or (peek(position) >> (16 - over) != (1 << over) - 1).any():
        raise ValueError("a scan has bits over")
    ends = np.searchsorted(np.array(owner), np.arange(len(frames) + 1))
    bounds = dc_start[ends]
    return [found[bounds[f] : bounds[f + 1]] for f in range(len(frames))]


def thumbnails(frames: list[Frame], exact: bool = False) -> list[np.ndarray]:
    """Luminance thumbnails, one 8-bit sample for each block of the image.

    Means beyond 0 to 255, which rounding may cause, are clipped; if exact,
    they raise ValueError, as stored payloads have none.
    """
    out: list = [None] * len(frames)
    groups: dict[str, list[int]] = {}
    for k, frame in enumerate(frames):
        groups.setdefault(frame.key(), []).append(k)
    for own in groups.values():
        for k, dc in zip(own, decode_dc([frames[k] for k in own])):
            frame, scan = frames[k], frames[k].luminance()
            _, across, down = frame.layout()
            _, h, v, table = frame.components[0]
            if len(scan.parts) == 1:
                grid = dc.reshape(down, across)
            else:
                grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            means = (grid * scan.quant[table] + 4) // 8 + 128
            if exact and ((means < 0) | (means > 255)).any():
                raise ValueError("a stored sample is out of range")
            out[k] = np.clip(means, 0, 255).astype(np.uint8)
    return out


def thumbnail_hashes(thumb: np.ndarray) -> tuple[int, int]:
    """64-bit average hash and difference hash of a thumbnail's 8 by 9 cells."""
    rows, cols = (np.arange(k + 1) * n // k for k, n in zip((8, 9), thumb.shape))
    cells = np.add.reduceat(thumb.astype(np.float64), np.minimum(rows[:-1], thumb.shape[0] - 1), axis=0)
    cells = np.add.reduceat(cells, np.minimum(cols[:-1], thumb.shape[1] - 1), axis=1)
    cells /= np.maximum(np.diff(rows), 1)[:, None] * np.maximum(np.diff(cols), 1)[None, :]
    bits = (cells[:, :8] > cells[:, :8].mean(), cells[:, 1:] > cells[:, :-1])
    return tuple(int.from_bytes(np.packbits(b).tobytes(), "big") for b in bits)


def _store(batches):
    for batch in batches:
        data, off = common.text_bytes(batch.column(1))
        for i, j in common.slices(off, CHUNK):
            size = np.diff(off[i : j + 1])
            rows = np.maximum(-(-size // ROW), 1)
            samples = np.full(int(rows.sum()) * ROW, 255, np.uint8)
            put = np.concatenate(([0], np.cumsum(rows)[:-1])) * ROW
            for p, a, n in zip(put.tolist(), off[i:j].tolist(), size.tolist()):
                samples[p : p + n] = data[a : a + n]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(encode(samples, rows.tolist()), pa.binary())], names=["id", "media"])


_FEATURES = "id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _read(batches):
    for batch in batches:
        _, off = common.text_bytes(batch.column(1))
        for i, j in common.slices(off, CHUNK):
            media = batch.column(1).slice(i, j - i).to_pylist()
            frames = [parse(m) for m in media]
            thumbs = iter(thumbnails([f for own in frames for f in own], exact=True))
            rows = []
            for m, own in zip(media, frames):
                images = [next(thumbs) for _ in own]
                payload = b"".join(t.tobytes() for t in images)
                whole = np.concatenate(images)
                a, d = thumbnail_hashes(whole)
                rows.append((len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"{8 * whole.shape[1]}x{8 * whole.shape[0]}:{a:016x}:{d:016x}"))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store_media(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id and media: the text's UTF-8 bytes, padded by bytes 255 to a positive
    multiple of 576, as baseline JPEG. Null texts are empty; repeated rows and
    null ids are stored each on its own; other columns are ignored."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, "id bigint, media binary").withColumnRenamed("id", id_col)


def read_media(media: DataFrame, id_col="doc_id", media_col="media") -> DataFrame:
    """The payload read back from each media value, described, and its features.

    feature is the image's width, height, average hash and difference hash of
    the thumbnail. n_bytes leaves out the padding, which UTF-8 never holds.
    A value that is no baseline JPEG, is cut short, has bits that are no code or
    bits over, fails the query. Empty tables give no rows.
    """
    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(_read, _FEATURES).withColumnRenamed("id", id_col)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Scratch(spark, "media").keep(store_media(common.read(spark, sf_dir, "documents")), "zstd")
    return read_media(stored)
