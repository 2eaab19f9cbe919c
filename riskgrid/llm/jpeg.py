"""Media columns: baseline JPEG in numpy.

``encode`` keeps any bytes losslessly in baseline JPEG frames: the format's unit is the quantised DC coefficient of an
8x8 luminance block, one for each byte, with no AC coefficients. ``decode_dc`` reads baseline JPEG: it parses markers, builds
decoding tables from the DHT segments, removes byte stuffing, decodes the scan, and returns the DC-only thumbnail, a sample
for each block. Restart intervals decode in lockstep: step k decodes symbol k of all intervals of a batch. Frames of several
components, interleaved in any subsampling or scan by scan, give the thumbnail of their first component, the luminance.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskgrid.llm.kernel import buffers, chunks, mapper, ramp

#: Blocks in a row of a frame, and in a restart interval.
WIDTH = 64
#: Block rows in a frame: 65,535 lines at most.
ROWS = 8191
FRAME = WIDTH * ROWS

# Fixed values of the format (ITU-T T.81).
SOI, EOI, SOS, DQT, DHT, SOF0, DRI = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC0, 0xDD
#: DC code lengths by category of the difference: small differences of letters are common.
DC_LENGTHS = {0: 4, 1: 4, 2: 4, 3: 3, 4: 3, 5: 2, 6: 3, 7: 4, 8: 5, 9: 6}
AC_LENGTHS = {0: 1}  # end of block


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The BITS and HUFFVAL bytes of a DHT segment, and (code, length) by symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    bits, codes, code, was = [0] * 16, {}, 0, 0
    for s in order:
        code <<= lengths[s] - was
        was = lengths[s]
        codes[s] = (code, was)
        bits[was - 1] += 1
        code += 1
    return bytes(bits) + bytes(order), codes


_DC_SEGMENT, _DC_CODES = _canonical(DC_LENGTHS)
_AC_SEGMENT, _AC_CODES = _canonical(AC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(rows: int) -> bytes:
    size = (rows * 8).to_bytes(2, "big") + (WIDTH * 8).to_bytes(2, "big")
    return (
        bytes([0xFF, SOI])
        + _segment(DQT, b"\x00" + b"\x08" + b"\x01" * 63)
        + _segment(SOF0, b"\x08" + size + b"\x01\x01\x11\x00")
        + _segment(DHT, b"\x00" + _DC_SEGMENT)
        + _segment(DHT, b"\x10" + _AC_SEGMENT)
        + _segment(DRI, WIDTH.to_bytes(2, "big"))
        + _segment(SOS, b"\x01\x01\x00\x00\x3f\x00")
    )


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number of a whole block (DC code, magnitude, end of block) by difference + 255."""
    value, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, n = _DC_CODES[category]
        magnitude = d if d > 0 else d + (1 << category) - 1
        eob, m = _AC_CODES[0]
        value[d + 255] = ((code << category) + magnitude << m) + eob
        size[d + 255] = n + category + m
    return value, size


_VALUE, _SIZE = _code_table()


def pad(data: np.ndarray, offs: np.ndarray, unit: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Each text followed by bytes 0 up to a positive multiple of ``unit``."""
    lengths = np.diff(offs)
    padded = np.maximum(-(-lengths // unit) * unit, unit)
    at = np.concatenate([[0], np.cumsum(padded)])
    out = np.zeros(at[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - offs[:-1], lengths)] = data
    return out, at


def encode(payload: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """JPEG frames of payloads whose lengths are positive multiples of 64; a payload over 524,224 bytes has several frames."""
    blocks = payload.reshape(-1, WIDTH).astype(np.int16) - 128
    diff = np.diff(blocks, axis=1, prepend=np.int16(0)) + np.int16(255)
    size = _SIZE[diff]
    ends = np.cumsum(size, axis=1)
    used = -(-ends[:, -1] // 8)
    n, room = len(blocks), int(used.max()) + 3
    scan = np.zeros(n * room, np.uint8)
    base = np.arange(n) * room
    for k in range(WIDTH):  # the intervals are apart, so a fancy |= has no clash
        end = ends[:, k]
        at = (end - size[:, k]) >> 3
        bits = _VALUE[diff[:, k]] << (24 - (end - (at << 3))).astype(np.uint32)
        o = base + at
        scan[o] |= (bits >> 16).astype(np.uint8)
        scan[o + 1] |= (bits >> 8).astype(np.uint8)
        scan[o + 2] |= bits.astype(np.uint8)
    scan = scan.reshape(n, room)
    spare = used * 8 - ends[:, -1]
    scan[np.arange(n), used - 1] |= ((1 << spare) - 1).astype(np.uint8)  # the last byte is filled with ones
    raw = scan[np.arange(room) < used[:, None]]
    stuffed = raw == 0xFF
    grown = np.add.reduceat(stuffed, np.concatenate([[0], np.cumsum(used)[:-1]])) + used
    body = np.zeros(len(raw) + int(stuffed.sum()), np.uint8)
    body[np.arange(len(raw)) + np.cumsum(stuffed) - stuffed] = raw
    # The layout: each frame a head, its intervals with restart markers between them, and EOI.
    per_text = np.diff(offs) // WIDTH
    frames_of = -(-per_text // ROWS)
    rows = np.full(int(frames_of.sum()), ROWS)
    rows[np.cumsum(frames_of) - 1] = per_text - (frames_of - 1) * ROWS
    frame = np.repeat(np.arange(len(rows)), rows)
    in_frame = ramp(rows)
    heads = {r: np.frombuffer(_head(int(r)), np.uint8) for r in np.unique(rows)}
    head = len(next(iter(heads.values())))
    marked = grown + 2  # RSTm or, after the last, EOI
    ends = np.cumsum(marked) + (frame + 1) * head
    out = np.empty(int(ends[-1]), np.uint8)
    begins = ends - marked
    out[ramp(grown) + np.repeat(begins, grown)] = body
    out[ends - 2] = 0xFF
    last = in_frame == rows[frame] - 1
    out[ends - 1] = np.where(last, EOI, 0xD0 + in_frame % 8)
    tops = begins[in_frame == 0] - head
    for i, r in enumerate(rows):
        out[tops[i] : tops[i] + head] = heads[r]
    stops = ends[last]
    return out, np.concatenate([[0], stops[np.cumsum(frames_of) - 1]])


def _decoder(segment: bytes) -> np.ndarray:
    """By 16 bits: the length of the code they begin with times 256, plus its symbol; 0 if there is none."""
    out, code, k = np.zeros(1 << 16, np.uint16), 0, 16
    for length in range(1, 17):
        for _ in range(segment[length - 1]):
            if k >= len(segment):
                raise ValueError("DHT segment too short")
            at = code << (16 - length)
            out[at : at + (1 << (16 - length))] = length * 256 + segment[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


@dataclass(frozen=True)
class Component:
    id: int
    h: int  # blocks of an MCU across, and down
    v: int
    quant: int


@dataclass(frozen=True)
class Scan:
    """The head of a JPEG up to the scan that holds its luminance."""

    width: int
    height: int
    interval: int  # MCUs between restart markers, 0 for none
    components: tuple[Component, ...]  # of the scan, in its order
    dc: tuple[bytes, ...]
    ac: tuple[bytes, ...]
    luminance: int  # which of them is the frame's first
    step: int  # quantiser of its DC coefficient
    most: tuple[int, int]  # largest h and v in the frame
    at: int  # where the entropy-coded bytes begin

    def mcus(self) -> tuple[int, int]:
        """MCUs across and down: of a scan of one component, its blocks that hold samples."""
        c, (h, v) = self.components[0], self.most
        if len(self.components) > 1:
            return -(-self.width // (8 * h)), -(-self.height // (8 * v))
        return -(-(-(-self.width * c.h // h)) // 8), -(-(-(-self.height * c.v // v)) // 8)

    def pattern(self) -> np.ndarray:
        """The component of each block of an MCU."""
        single = len(self.components) == 1
        return np.concatenate([np.full(1 if single else c.h * c.v, k) for k, c in enumerate(self.components)])


def parse(media: bytes, at: int = 0) -> Scan:
    """The JPEG that begins at ``at`` up to the scan of its first component. Raises ValueError for what isn't baseline."""
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    at += 2
    tables: dict[int, bytes] = {}
    quant: dict[int, int] = {}
    frame: dict[int, Component] = {}
    size, interval = (0, 0), 0
    try:
        while True:
            if media[at] != 0xFF:
                raise ValueError("marker expected")
            while media[at + 1] == 0xFF:  # fill bytes
                at += 1
            marker, length = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + length]
            if length < 2 or len(body) != length - 2 or marker in (0xD8, EOI):
                raise ValueError("a segment ends early")
            at += 2 + length
            if marker == DQT:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker in (SOF0, SOF0 + 1):
                if body[0] != 8:
                    raise ValueError("8-bit samples expected")
                size = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
                frame = {body[k]: Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)}
                if not size[0] or not size[1] or any(not 1 <= x <= 4 for c in frame.values() for x in (c.h, c.v)):
                    raise ValueError("a size of nothing")
            elif 0xC2 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == DHT:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == DRI:
                interval = int.from_bytes(body, "big")
            elif marker == SOS:
                chosen = [(frame[body[k]], body[k + 1]) for k in range(1, 1 + 2 * body[0], 2)]
                first = next(iter(frame.values()))
                if first in [c for c, _ in chosen]:
                    parts = tuple(c for c, _ in chosen)
                    most = max(c.h for c in frame.values()), max(c.v for c in frame.values())
                    return Scan(*size, interval, parts, tuple(tables[t >> 4] for _, t in chosen), tuple(tables[16 + (t & 15)] for _, t in chosen), parts.index(first), quant[first.quant], most, at)
                while not (media[at] == 0xFF and media[at + 1] not in (0, *range(0xD0, 0xD8))):  # another component's scan
                    at += 1
    except (IndexError, KeyError, StopIteration) as e:
        raise ValueError("not a whole JPEG") from e


def _lockstep(bits: np.ndarray, begins: np.ndarray, blocks: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """DC values, before dequantisation, of intervals of unstuffed scan bytes; ``bits`` ends with 4 spare bytes.

    A row for each interval, as wide as the longest. An interval takes a step for each symbol until it has all its blocks.
    """
    n, most = len(begins), int(blocks.max())
    out = np.zeros((n, most), np.int32)
    at, block, coefficient, previous = begins * 8, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.arange(n)
    word = bits[:-3].astype(np.uint32) << 24
    word |= bits[1:-2].astype(np.uint32) << 16
    word |= bits[2:-1].astype(np.uint32) << 8
    word |= bits[3:]
    end = len(word) * 8

    def take(p: np.ndarray) -> np.ndarray:
        return word[p >> 3] << (p & 7).astype(np.uint32)  # 25 bits at least

    eob = int(np.flatnonzero((ac & 255 == 0) & (ac > 0))[0]) if ((ac & 255 == 0) & (ac > 0)).any() else -1
    eob_bits = int(ac[eob] >> 8) if eob >= 0 else 0
    even = bool((blocks == most).all())
    while len(live):
        if int(at.max()) >= end:
            raise ValueError("scan ends early")
        if not coefficient.any():  # all stand at a DC coefficient
            w = take(at)
            found = dc[w >> 16]
            size, category = (found >> 8).astype(np.int64), (found & 255).astype(np.int64)
            if not size.all() or int(category.max()) > 11:
                raise ValueError("bad DC code")
            value = (take(at + size) >> 16 >> (16 - category).astype(np.uint32)).astype(np.int64)
            value -= np.where((category > 0) & (value < (1 << np.maximum(category - 1, 0))), (1 << category) - 1, 0)
            previous += value
            out[live, block] = previous
            at += size + category
            # An end of block that follows is taken at once.
            if eob >= 0:
                ends = take(np.minimum(at, end - 1)) >> (32 - eob_bits) == eob >> (16 - eob_bits)
                at += np.where(ends, eob_bits, 0)
            else:
                ends = np.zeros(len(live), bool)
            block += ends
            coefficient = np.where(ends, 0, 1)
        else:
            inside = coefficient > 0
            w = take(at)
            found = ac[w >> 16]
            size, symbol = (found >> 8).astype(np.int64), (found & 255).astype(np.int64)
            if not size[inside].all():
                raise ValueError("bad AC code")
            run, category = symbol >> 4, symbol & 15
            done = inside & ((symbol == 0) | (coefficient + run + 1 > 63))
            at += np.where(inside, size + category, 0)
            coefficient = np.where(done | ~inside, 0, coefficient + run + 1)
            block += done
            even = False
        if not even or int(block[0]) == most:
            going = block < blocks[live]
            if not going.all():
                live, at, block, coefficient, previous = live[going], at[going], block[going], coefficient[going], previous[going]
    return out


def _lockstep_mixed(bits: np.ndarray, begins: np.ndarray, blocks: np.ndarray, dc: np.ndarray, ac: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """As ``_lockstep`` where the blocks are of several components: tables by component, components by place in the MCU."""
    n, most = len(begins), int(blocks.max())
    out = np.zeros((n, most), np.int32)
    at, block, coefficient, previous = begins * 8, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, len(dc)), np.int64)
    live = np.flatnonzero(blocks > 0)
    word = np.zeros(len(bits) - 3, np.uint32)
    for k in range(4):
        word |= bits[k : len(bits) - 3 + k].astype(np.uint32) << (24 - 8 * k)
    while len(live):
        p = at[live]
        if int(p.max()) >= len(word) * 8 - 32:
            raise ValueError("scan ends early")
        kind = pattern[block[live] % len(pattern)]
        first = coefficient[live] == 0
        w = word[p >> 3] << (p & 7).astype(np.uint32)
        found = np.where(first, dc[kind, w >> 16], ac[kind, w >> 16]).astype(np.int64)
        size, symbol = found >> 8, found & 255
        if not size.all() or (first & (symbol > 11)).any():
            raise ValueError("bad code")
        category = np.where(first, symbol, symbol & 15)
        q = p + size
        value = ((word[q >> 3] << (q & 7).astype(np.uint32)) >> 16 >> (16 - category).astype(np.uint32)).astype(np.int64)
        value -= np.where((category > 0) & (value < (1 << np.maximum(category - 1, 0))), (1 << category) - 1, 0)
        opened = live[first]
        previous[opened, kind[first]] += value[first]
        out[opened, block[opened]] = previous[opened, kind[first]]
        at[live] = q + category
        run = np.where(first, 0, symbol >> 4)
        ends = ~first & ((symbol == 0) | (coefficient[live] + run + 1 > 63))
        coefficient[live] = np.where(ends, 0, coefficient[live] + run + 1)
        block[live] += ends
        live = live[block[live] < blocks[live]]
    return out


def _layout(p: Scan) -> tuple[np.ndarray, tuple[int, int]]:
    """The blocks of the luminance, as places in the scan, in rows; and how many of them hold samples, across and down."""
    across, down = p.mcus()
    c = p.components[p.luminance]
    wide, high = -(-(-(-p.width * c.h // p.most[0])) // 8), -(-(-(-p.height * c.v // p.most[1])) // 8)
    if len(p.components) == 1:
        return np.arange(across * down), (wide, high)
    pattern = p.pattern()
    before = int(np.flatnonzero(pattern == p.luminance)[0])
    y, x = np.divmod(np.arange(wide * high), wide)
    return (y // c.v * across + x // c.h) * len(pattern) + before + y % c.v * c.h + x % c.h, (wide, high)


def decode_dc(media: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """DC-only luminance samples of stored media, one for each block: samples, offsets, and (width, height, frames) of each."""
    n = len(offs) - 1
    raw = media.tobytes()
    marks = np.flatnonzero(media[:-1] == 0xFF)
    code = media[marks + 1]
    restart = marks[(code >= 0xD0) & (code <= 0xD7)]
    finish = marks[code == EOI]
    markers = marks[(code != 0) & (code != 0xFF) & ~((code >= 0xD0) & (code <= 0xD7))]
    groups: dict[tuple, list] = {}
    sizes, dims = np.zeros(n, np.int64), []
    for i in range(n):
        at, frames, width, height = int(offs[i]), 0, 0, 0
        while at < offs[i + 1]:
            p = parse(raw, at)
            ends = np.searchsorted(markers, p.at), np.searchsorted(finish, p.at)
            if ends[0] == len(markers) or ends[1] == len(finish) or finish[ends[1]] >= offs[i + 1]:
                raise ValueError("no end of the image")
            stop, last = markers[ends[0]], finish[ends[1]]
            inner = restart[np.searchsorted(restart, p.at) : np.searchsorted(restart, stop)]
            across, down = p.mcus()
            count, unit = across * down, len(p.pattern())
            step = p.interval or count
            if len(inner) != -(-count // step) - 1:
                raise ValueError("restart markers don't match the size")
            blocks = np.full(len(inner) + 1, step)
            blocks[-1] = count - step * len(inner)
            places, (wide, high) = _layout(p)
            groups.setdefault((p.dc, p.ac, p.step, tuple(p.pattern().tolist())), []).append((i, int(sizes[i]), np.concatenate([[p.at], inner + 2]), np.concatenate([inner, [stop]]), blocks * unit, places if unit > 1 else None))
            sizes[i] += wide * high
            at, frames, width, height = int(last) + 2, frames + 1, p.width, height + p.height
        dims.append((width, height, frames))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    samples = np.zeros(int(starts[-1]), np.uint8)
    for (dc, ac, step, pattern), parts in groups.items():
        begins, ends, blocks = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        lengths = ends - begins
        where = ramp(lengths) + np.repeat(begins, lengths)
        body = media[where]
        keep = np.ones(len(body), bool)
        keep[1:] = ~((body[1:] == 0) & (body[:-1] == 0xFF))
        clean = np.concatenate([body[keep], np.full(8, 0xFF, np.uint8)])
        kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lengths)[:-1]])]
        if len(pattern) == 1:
            values = _lockstep(clean, kept, blocks, _decoder(dc[0]), _decoder(ac[0]))
        else:
            values = _lockstep_mixed(clean, kept, blocks, np.stack([_decoder(t) for t in dc]), np.stack([_decoder(t) for t in ac]), np.array(pattern))
        values = np.clip((values * step + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        if (blocks == values.shape[1]).all():
            flat = values.ravel()
        else:
            flat = values[np.arange(values.shape[1]) < blocks[:, None]]
        if len(pattern) == 1:
            target = np.concatenate([starts[p[0]] + p[1] + np.concatenate([[0], np.cumsum(p[4])[:-1]]) for p in parts])
            samples[ramp(blocks) + np.repeat(target, blocks)] = flat
            continue
        at = 0
        for i, before, _, _, own, places in parts:
            samples[starts[i] + before : starts[i] + before + len(places)] = flat[at + places]
            at += int(own.sum())
    return samples, starts, dims


def thumbnail_hash(samples: np.ndarray, width: int = WIDTH) -> int:
    """A 64-bit difference hash of a thumbnail, from 8 rows of 9 means."""
    rows = len(samples) // width
    picture = samples[: rows * width].reshape(rows, width)
    down = np.add.reduceat(picture.astype(np.int64), np.arange(9) * width // 9, axis=1)
    cuts = np.minimum(np.arange(9) * rows // 8, rows - 1)
    sums = np.concatenate([np.zeros((1, 9), np.int64), np.cumsum(down, axis=0)])
    top, bottom = cuts[:-1], np.maximum(cuts[1:], cuts[:-1] + 1)
    cells = (sums[bottom] - sums[top]) / (bottom - top)[:, None] / np.diff([*(np.arange(9) * width // 9), width])
    return int.from_bytes(np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes(), "big")


def _store(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offs = buffers(batch.column(1))
    parts, lengths = [], []
    for _, _, part, at in chunks(data, offs):
        media, ends = encode(*pad(part, at))
        parts.append(media)
        lengths.append(np.diff(ends))
    media, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(media)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), column], names=["doc_id", "n_bytes", "media"])


def _read(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offs = buffers(batch.column(2))
    rows: list[tuple] = []
    for _, j, part, at in chunks(data, offs):
        samples, ends, dims = decode_dc(part, at)
        for k in range(len(at) - 1):
            payload = samples[ends[k] : ends[k + 1]]
            width, height, frames = dims[k]
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), int(at[k + 1] - at[k]), hashlib.sha256(part[at[k] : at[k + 1]]).hexdigest(), f"{width}x{height}/{frames}:{thumbnail_hash(payload, -(-width // 8)):016x}"))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", *names])


def store(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text (null: empty) as lossless baseline JPEG.

    Equal texts give equal media, and rows that repeat a row each. A text of any length is stored, in frames of 524,224
    bytes; the media of a text must stay below 2 GB, as any binary value. An empty table gives an empty one; other columns,
    whatever their names, aren't read.
    """
    chosen = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text].alias("text"))
    return chosen.mapInArrow(mapper(_store), "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads stored JPEG back: payload size and digests, dimensions and a hash of the DC-only thumbnail.

    Raises for media that ``store`` didn't write; ``thumbnails`` takes any. Rows that repeat give a row each.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        mapper(_read), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def thumbnails(images: DataFrame, id_column: str, image: str) -> DataFrame:
    """id, width, height, thumbnail (bytes, a sample for each 8x8 luminance block, in rows), thumbnail_hash, error of each image.

    Any baseline JPEG is read, in one component or several. Null, empty, broken, and other images have null values and an
    error; rows that repeat give a row each; other columns, whatever their names, aren't read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for value in batch.column(1):
            try:
                raw = value.as_py()
                if not raw:
                    raise ValueError("no image")
                samples, _, [(width, height, _)] = decode_dc(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                p = parse(raw)
                rows.append((width, height, samples.tobytes(), f"{thumbnail_hash(samples, _layout(p)[1][0]):016x}", None))
            except ValueError as e:
                rows.append((None, None, None, None, str(e)))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["id", "width", "height", "thumbnail", "thumbnail_hash", "error"])

    chosen = images.select(images[id_column].cast("long").alias("id"), images[image].cast("binary").alias("image"))
    return chosen.mapInArrow(mapper(run), "id long, width int, height int, thumbnail binary, thumbnail_hash string, error string")
