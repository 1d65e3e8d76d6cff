"""Baseline JPEG in numpy: lossless storage of bytes as quantised coefficients, and a reader for baseline files.

The writer makes one-component images whose 64 quantised coefficients per 8x8 block, in scan order, are the payload's
bytes less 128. Every `LANE_BLOCKS` blocks end in a restart marker, so the entropy-coded data fall into short lanes
that are coded and decoded in lockstep: one numpy step handles the next symbol of thousands of lanes, of many images.

The reader parses the markers of any baseline (SOF0, 8 bit, interleaved single scan) file, Huffman-decodes its scan
and gives dimensions, coefficients and the luminance thumbnail that DC coefficients alone make.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Bytes of payload in a row of blocks of the narrowest image: three blocks.
UNIT = 192
LANE_BLOCKS = 3
#: Lanes that are coded or decoded together; bounds memory for images of any size.
LANES_AT_ONCE = 16_384
MAX_ROWS = 8_191
DC_QUANT = 8
EOB, ZRL = 0x00, 0xF0
APART = 1 << 15


def _canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Counts by length 1..16, symbols in code order, and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(1 for s in order if lengths[s] == n) for n in range(1, 17)]
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return counts, order, codes


#: Our own codes: 4 bits for a DC size, for an AC size without a run and for the end of a block, 10 bits for the rest.
_DC = _canonical({s: 4 for s in range(12)})
_AC = _canonical(
    {s: 4 for s in range(1, 11)} | {EOB: 4, ZRL: 10} | {r << 4 | s: 10 for r in range(1, 16) for s in range(1, 11)}
)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables() -> bytes:
    quant = bytes([0, DC_QUANT] + [1] * 63)
    huffman = b"".join(
        _segment(0xC4, bytes([kind << 4]) + bytes(t[0]) + bytes(t[1])) for kind, t in ((0, _DC), (1, _AC))
    )
    return _segment(0xDB, quant) + huffman + _segment(0xDD, struct.pack(">H", LANE_BLOCKS))


_TABLES = _tables()
_SOS = _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
_SIZE = np.array([abs(v).bit_length() for v in range(256)], np.uint8)
_DC_CODE = np.array([_DC[2][s][0] for s in range(12)], np.uint64)
_AC_CODE = np.zeros(256, np.uint64)
_AC_LEN = np.zeros(256, np.uint8)
for _s, (_c, _n) in _AC[2].items():
    _AC_CODE[_s], _AC_LEN[_s] = _c, _n


def _amplitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The `size` low bits that stand for v."""
    return np.where(v >= 0, v, v + (1 << size.astype(np.int32)) - 1).astype(np.uint64)


def _pack(code: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes of the codes laid end to end; lengths up to 64 bits, multiple of 8 in sum."""
    used = length > 0
    code, length = code[used], length[used].astype(np.int64)
    end = np.cumsum(length)
    at = end - length
    word, over = at >> 6, (at & 63) + length - 64
    head = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
    words = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(head, first)
    spill = np.flatnonzero(over > 0)
    words[word[spill] + 1] |= code[spill] << (64 - over[spill]).astype(np.uint64)
    return words.astype(">u8").view(np.uint8)[: int(end[-1] >> 3)]


def _plain() -> tuple[np.ndarray, np.ndarray]:
    """Code with amplitude, and length, of an AC coefficient -128..127 that follows no zero; 0 itself has none."""
    v = np.arange(-128, 128)
    size = _SIZE[np.abs(v)]
    code = _AC_CODE[size] << size.astype(np.uint64) | _amplitude(v, size)
    length = _AC_LEN[size] + size
    code[128] = length[128] = 0
    return code, length


_PLAIN_CODE, _PLAIN_LEN = _plain()


def _after_zeros(blocks: np.ndarray, code: np.ndarray, length: np.ndarray) -> None:
    """Puts runs of zeros into the codes of the coefficients that end them."""
    some = np.flatnonzero((blocks[:, 1:] == 0).any(1))
    if not len(some):
        return
    v = blocks[some]
    v[:, 0] = 1
    last = np.maximum.accumulate(np.where(v != 0, np.arange(64), 0), 1)
    b, k = np.nonzero((v[:, 1:] != 0) & (v[:, :-1] == 0))
    k += 1
    run, ac = k - last[b, k - 1] - 1, v[b, k]
    size = _SIZE[np.abs(ac)]
    symbol = (run & 15) << 4 | size
    bits = _AC_CODE[symbol] << size.astype(np.uint64) | _amplitude(ac, size)
    n_bits = (_AC_LEN[symbol] + size).astype(np.int64)
    for n in range(1, 4):  # at most three runs of 16 zeros precede a coefficient
        more = run >> 4 >= n
        bits[more] |= _AC_CODE[ZRL] << n_bits[more].astype(np.uint64)
        n_bits[more] += _AC_LEN[ZRL]
    code[some[b], k], length[some[b], k] = bits, n_bits


def _join_slots(code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every four codes as one where they fit 64 bits: packing takes a quarter of the steps."""
    if length.max() > 16:
        return code.ravel(), length.ravel()
    joined, total = code[:, ::4].copy(), length[:, ::4].copy()
    for i in (1, 2, 3):
        joined <<= length[:, i::4].astype(np.uint64)
        joined |= code[:, i::4]
        total += length[:, i::4]
    return joined.ravel(), total.ravel()


def _encode_lanes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed bytes of lanes of coefficients (lanes, LANE_BLOCKS, 64), and the length of each lane."""
    lanes = v.shape[0]
    slots = 65 * LANE_BLOCKS + 1  # 64 coefficients and the end of each block, and the lane's padding
    code, length = np.zeros((lanes, slots), np.uint64), np.zeros((lanes, slots), np.uint8)
    blocks, parts = v.reshape(-1, 64), (lanes, LANE_BLOCKS, 65)
    by_block, by_block_len = np.empty(parts, np.uint64), np.empty(parts, np.uint8)
    by_block[:, :, :64], by_block_len[:, :, :64] = _PLAIN_CODE[v + 128], _PLAIN_LEN[v + 128]
    flat, flat_len = by_block.reshape(-1, 65), by_block_len.reshape(-1, 65)
    _after_zeros(blocks, flat, flat_len)
    diff = np.diff(v[:, :, 0], axis=1, prepend=0).ravel()
    size = _SIZE[np.abs(diff)]
    flat[:, 0] = _DC_CODE[size] << size.astype(np.uint64) | _amplitude(diff, size)
    flat_len[:, 0] = 4 + size
    flat[:, 64], flat_len[:, 64] = _AC_CODE[EOB], np.where(blocks[:, 63] == 0, _AC_LEN[EOB], 0)
    flat[flat_len == 0] = 0
    total = by_block_len.sum((1, 2), dtype=np.int64)
    pad = (-total) % 8
    code[:, :-1], code[:, -1] = by_block.reshape(lanes, -1), (1 << pad) - 1
    length[:, :-1], length[:, -1] = by_block_len.reshape(lanes, -1), pad
    raw = _pack(*_join_slots(code, length))
    stuffed = np.cumsum(raw == 0xFF)
    out = np.zeros(len(raw) + int(stuffed[-1]), np.uint8)
    out[np.arange(len(raw)) + stuffed - (raw == 0xFF)] = raw
    ends = np.cumsum((total + pad) >> 3)
    return out, np.diff(ends + stuffed[ends - 1], prepend=0)


def _shape(n_bytes: int) -> tuple[int, int]:
    """Blocks across and down for a payload of so many bytes, a multiple of UNIT."""
    units = n_bytes // UNIT
    k = -(-units // MAX_ROWS)
    return LANE_BLOCKS * k, -(-units // k)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One JPEG file for each payload (a positive multiple of UNIT bytes)."""
    shapes = [_shape(len(p)) for p in payloads]
    raw = b"".join(p.ljust(64 * w * h, b"\x80") for p, (w, h) in zip(payloads, shapes, strict=True))
    v = (np.frombuffer(raw, np.uint8).astype(np.int32) - 128).reshape(-1, LANE_BLOCKS, 64)
    parts, sizes = zip(*(_encode_lanes(v[i : i + LANES_AT_ONCE]) for i in range(0, len(v), LANES_AT_ONCE)), strict=True)
    data, size = np.concatenate(parts), np.concatenate(sizes)
    per_image = np.array([w * h // LANE_BLOCKS for w, h in shapes])
    first = np.cumsum(per_image) - per_image
    number = np.arange(len(size)) - np.repeat(first, per_image)
    out = np.zeros(len(data) + 2 * len(size), np.uint8)
    out[np.arange(len(data)) + 2 * np.repeat(np.arange(len(size)), size)] = data
    ends = np.cumsum(size + 2)
    out[ends - 2], out[ends - 1] = 0xFF, 0xD0 + number % 8
    out[ends[first + per_image - 1] - 1] = 0xD9
    files, start = [], 0
    for p, (w, h), last in zip(payloads, shapes, first + per_image - 1, strict=True):
        frame = struct.pack(">BHHBBBB", 8, 8 * h, 8 * w, 1, 1, 0x11, 0)
        head = b"\xff\xd8" + _segment(0xFE, b"payload=%d" % len(p)) + _TABLES + _segment(0xC0, frame) + _SOS
        files.append(head + out[start : ends[last]].tobytes())
        start = ends[last]
    return files


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits, of the symbol they start with: amplitude << 16 | bits taken << 8 | run << 4 | size.

    0: no code. Where code and amplitude exceed 16 bits only the code is taken, and APART is set.
    """
    table, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            low, size = code << (16 - n), symbols[k] & 15
            span = np.arange(low, (code + 1) << (16 - n))
            if n + size > 16:
                table[span] = APART | n << 8 | symbols[k]
            else:
                bits = span >> (16 - n - size) & ((1 << size) - 1)
                value = np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
                table[span] = value << 16 | (n + size) << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


@dataclass
class Image:
    """What the markers of a file say, and once decoded its coefficients (blocks in scan order, 64)."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    restart: int = 0
    quant: dict[int, list[int]] = field(default_factory=dict)
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    order: list[tuple[int, int, int]] = field(default_factory=list)
    mcus: tuple[int, int] = (0, 0)
    data: bytes = b""
    coefficients: np.ndarray | None = None

    def payload(self) -> bytes:
        """The bytes that `encode` stored."""
        n = int(self.comment.removeprefix(b"payload="))
        return (self.coefficients.ravel()[:n] + 128).astype(np.uint8).tobytes()

    def thumbnail(self) -> np.ndarray:
        """Luminance at an eighth of the size, from DC coefficients of the first component alone."""
        _, h, v, q = self.components[0]
        rows, across = self.mcus
        own = [i for i, (c, _, _) in enumerate(self.order) if c == 0]
        dc = self.coefficients[:, 0].reshape(rows, across, len(self.order))[:, :, own]
        grid = dc.reshape(rows, across, v, h).swapaxes(1, 2).reshape(rows * v, across * h)
        light = np.clip((grid * self.quant[q][0] + 4) // 8 + 128, 0, 255).astype(np.uint8)
        return light[: -(-self.height // 8), : -(-self.width // 8)]


def parse(blob: bytes) -> Image:
    """The markers of a baseline file; its scan's bytes are kept as they are."""
    if blob[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = Image(), 2
    while True:
        if at + 4 > len(blob) or blob[at] != 0xFF:
            raise ValueError("a marker is expected")
        marker, n = blob[at + 1], int.from_bytes(blob[at + 2 : at + 4], "big")
        body, at = blob[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = struct.unpack_from(">64H" if wide else ">64B", body, 1)
                image.quant[body[0] & 15], body = list(values), body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                m = 17 + sum(body[1:17])
                image.tables[body[0]], body = _lookup(bytes(body[1:17]), bytes(body[17:m])), body[m:]
        elif marker == 0xC0:
            image.height, image.width = struct.unpack_from(">HH", body, 1)
            image.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, len(body), 3)]
        elif marker == 0xDD:
            image.restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            _scan_layout(image, body)
            end = blob.rfind(b"\xff\xd9")
            image.data = blob[at : end if end >= at else len(blob)]
            return image
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError(f"not baseline: marker {marker:02x}")


def _scan_layout(image: Image, header: bytes) -> None:
    if header[0] != len(image.components):
        raise ValueError("only interleaved scans of all components")
    used = {header[1 + 2 * i]: header[2 + 2 * i] for i in range(header[0])}
    if len(image.components) == 1:
        image.components = [(image.components[0][0], 1, 1, image.components[0][3])]
    wide, high = (8 * max(c[i] for c in image.components) for i in (1, 2))
    image.mcus = (-(-image.height // high), -(-image.width // wide))
    image.order = [
        (k, used[c] >> 4, 0x10 | used[c] & 15) for k, (c, h, v, _) in enumerate(image.components) for _ in range(h * v)
    ]


def _lanes(image: Image) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and markers, and the start of each lane in them, with the end."""
    raw = np.frombuffer(image.data, np.uint8)
    after_ff = np.zeros(len(raw), bool)
    after_ff[1:] = raw[:-1] == 0xFF
    mark = after_ff & (raw & 0xF8 == 0xD0)
    keep = ~(mark | after_ff & (raw == 0))
    keep[:-1] &= ~mark[1:]
    starts = np.cumsum(keep)[np.flatnonzero(mark)] if mark.any() else np.zeros(0, np.int64)
    kept = raw[keep]
    return kept, np.concatenate([[0], starts, [len(kept)]]).astype(np.int64)


def decode(files: list[bytes]) -> list[Image]:
    """The files parsed and their scans decoded, all lanes of all files in lockstep."""
    images = [parse(f) for f in files]
    tables: dict[int, int] = {}
    stack: list[np.ndarray] = []

    def table_id(t: np.ndarray) -> int:
        if id(t) not in tables:
            tables[id(t)] = len(stack)
            stack.append(t)
        return tables[id(t)]

    widest = max((len(i.order) for i in images), default=1)
    layout = np.zeros((len(images), widest, 3), np.int64)  # component, DC table, AC table of each block of an MCU
    chunks, start, owner, n_blocks, offset = [], [], [], [], 0
    for k, image in enumerate(images):
        for j, (c, dc, ac) in enumerate(image.order):
            layout[k, j] = c, table_id(image.tables[dc]), table_id(image.tables[ac])
        kept, bounds = _lanes(image)
        total = image.mcus[0] * image.mcus[1]
        each = image.restart or total
        counts = np.minimum(each, total - each * np.arange(len(bounds) - 1)) * len(image.order)
        if (counts <= 0).any() or counts.sum() != total * len(image.order):
            raise ValueError("the scan has another number of restart intervals")
        chunks.append(kept)
        start.append(bounds[:-1] + offset)
        owner.append(np.full(len(counts), k))
        n_blocks.append(counts)
        offset += len(kept)
    if not images:
        return images
    data = np.concatenate([*chunks, np.zeros(16, np.uint8)]).astype(np.uint32)
    start, owner, n_blocks = np.concatenate(start), np.concatenate(owner), np.concatenate(n_blocks)
    luts = np.concatenate(stack)
    per_mcu = np.array([len(i.order) for i in images])
    first = np.cumsum(n_blocks) - n_blocks
    out = np.zeros((int(n_blocks.sum()), 64), np.int16)
    for i in range(0, len(start), LANES_AT_ONCE):
        part = slice(i, i + LANES_AT_ONCE)
        low = int(start[i])
        high = int(start[i + LANES_AT_ONCE]) if i + LANES_AT_ONCE < len(start) else offset
        window = data[low : high + 16]
        stop = np.append(start, offset)[i + 1 : i + 1 + LANES_AT_ONCE] - low
        _decode_lanes(window, start[part] - low, stop, n_blocks[part], first[part], layout[owner[part]], per_mcu[owner[part]], luts, out.reshape(-1))
    ends = np.cumsum([len(i.order) * i.mcus[0] * i.mcus[1] for i in images])
    for image, to, n in zip(images, ends, np.diff(ends, prepend=0), strict=True):
        image.coefficients = out[to - n : to]
    return images


def _decode_lanes(data, start, stop, n_blocks, first, layout, per_mcu, luts, out) -> None:
    """Each turn of the loop takes the next Huffman symbol of every lane that isn't finished."""
    window = data[:-4] << 24 | data[1:-3] << 16 | data[2:-2] << 8 | data[3:-1]
    last_bit = 8 * (len(window) - 1)
    pos, k, block, n_done = start * 8, np.zeros(len(start), np.int64), first.copy(), np.zeros(len(start), np.int64)
    in_mcu, lane = np.zeros(len(start), np.int64), np.arange(len(start))
    single = layout.shape[1] == 1
    pred = np.zeros((len(start), int(layout[:, :, 0].max()) + 1), np.int64)
    peek = lambda p: (window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF
    while len(lane):
        own = layout[:, 0] if single else layout[np.arange(len(lane)), in_mcu]
        is_dc = k == 0
        some_dc = is_dc.any()
        entry = luts[(np.where(is_dc, own[:, 1], own[:, 2]) if some_dc else own[:, 2]) * 65536 + peek(pos)]
        pos += entry >> 8 & 31
        value = entry >> 16
        if not entry.all():
            raise ValueError("a code that no table has")
        size = entry & 15
        apart = entry & APART
        if apart.any():
            a = np.flatnonzero(apart)
            bits, half = peek(pos[a]).astype(np.int64) >> (16 - size[a]), (1 << size[a]) >> 1
            value[a] = np.where(bits < half, bits - 2 * half + 1, bits)
            pos[a] += size[a]
        if pos.max() > last_bit:
            raise ValueError("the scan ends too early")
        run = entry >> 4 & 15
        put = size > 0
        if some_dc:
            d = np.flatnonzero(is_dc)
            c = own[d, 0]
            pred[lane[d], c] += value[d]
            value[d] = pred[lane[d], c]
            run[d], put[d] = 0, True
        k += run
        if k.max() > 63 and (k[put] > 63).any():
            raise ValueError("a run past the end of a block")
        if put.all():
            out[block * 64 + k] = value
        else:
            out[block[put] * 64 + k[put]] = value[put]
            k[~put & (run != 15)] = 63
        k += 1
        full = k >= 64
        if full.any():
            k[full] = 0
            block[full] += 1
            n_done[full] += 1
            if not single:
                in_mcu[full] = (in_mcu[full] + 1) % per_mcu[full]
            live = n_done < n_blocks
            if not live.all():
                if (pos[~live] > 8 * stop[~live]).any():
                    raise ValueError("a restart interval ends too early")
                pos, k, block, n_done, in_mcu, lane, stop = (x[live] for x in (pos, k, block, n_done, in_mcu, lane, stop))
                layout, per_mcu, n_blocks = layout[live], per_mcu[live], n_blocks[live]
