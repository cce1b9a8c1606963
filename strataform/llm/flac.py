"""FLAC as a media column: an encoder, and a decoder of Rice residuals and linear predictors.

Mono streams of 8-bit samples; others are named as a row's problem. Frames are decoded side by side: the seek
table tells where each begins, so one step reads one residual of every frame of a batch, in whole arrays. Header
and frame checksums and the digest of the samples are verified. Streams without a seek table, or with one that
leaves frames out, are decoded frame after frame. Frames are worked on in batches of a bounded size, so a stream
takes a few times its own bytes however long it is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from strataform.llm.common import prepare

BLOCK = 1024
#: Frames that are encoded or decoded at a time.
FRAMES = 2048
#: A seek table's length has 24 bits; streams with more frames get a point for each of so many.
POINTS = 900_000
#: Bytes in which a frame of unknown size must end.
MOST_FRAME = 1 << 22
RATE = 8000
LPC_ORDER = 4
#: Bits of a quantised coefficient, sign included.
PRECISION = 8
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
#: Fixed values of the format: block sizes by header code.
SIZES = {1: 192} | {c: 576 << (c - 2) for c in range(2, 6)} | {c: 256 << (c - 8) for c in range(8, 16)}
MOST_ORDER = 32


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        x = i << (bits - 8)
        for _ in range(8):
            x = (x << 1 ^ poly if x >> (bits - 1) else x << 1) & ((1 << bits) - 1)
        out.append(x)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_ZEROS = np.array([16] + [16 - i.bit_length() for i in range(1, 1 << 16)], np.int64)


def crc8(raw: bytes) -> int:
    x = 0
    for b in raw:
        x = int(_CRC8[x ^ b])
    return x


def crc16(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of many slices at once. They are aligned at their ends: zeros in front don't change this sum."""
    sums = np.zeros(len(starts), np.uint16)
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    ends, sizes = ends[order], sizes[order]
    if not len(sizes):
        return sums
    begun = np.searchsorted(-sizes, -np.arange(sizes[0], 0, -1), "right")
    for left, n in zip(range(int(sizes[0]), 0, -1), begun.tolist(), strict=True):
        x = sums[:n]
        sums[:n] = x << 8 ^ _CRC16[(x >> 8) ^ buf[ends[:n] - left]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _coded(number: int) -> bytes:
    """A frame's number in the extended UTF-8 of the format."""
    if number < 0x80:
        return bytes([number])
    tail = []
    lead = 0x1F
    while True:
        tail.append(0x80 | number & 0x3F)
        number >>= 6
        if number <= lead:
            return bytes([(~(2 * lead + 1) & 0xFF) | number, *reversed(tail)])
        lead >>= 1


@lru_cache(maxsize=100_000)
def frame_header(number: int, size: int) -> bytes:
    code = 10 if size == BLOCK else 7
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + _coded(number) + (b"" if code == 10 else (size - 1).to_bytes(2, "big"))
    return head + bytes([crc8(head)])


def _frames(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stream, number and size of each block."""
    counts = np.array([-(-len(p) // BLOCK) for p in payloads])
    stream = np.repeat(np.arange(len(payloads)), counts)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(counts) - counts, counts)
    return stream, number, np.minimum(BLOCK, np.array([len(p) for p in payloads])[stream] - number * BLOCK)


def _lpc(x: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts by autocorrelation and Levinson's recursion, a row for each block."""
    y = np.where(real, x, 0).astype(np.float32)
    n = len(y)
    r = np.stack([np.einsum("ij,ij->i", y[:, lag:], y[:, : y.shape[1] - lag]).astype(np.float64) for lag in range(LPC_ORDER + 1)], 1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-3
    a, error = np.zeros((n, LPC_ORDER)), r[:, 0].copy()
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], r[:, i:0:-1])) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error *= np.maximum(1 - k * k, 1e-12)
    most = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(most)).astype(np.int64), 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int32), shift


def _encode_frames(flat: np.ndarray, number: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames of blocks that lie one after the other, and where each begins and the last ends. Block by block the
    shortest form wins: constant, verbatim, a fixed predictor of order 0 to 2, or a linear one fitted to the block."""
    n = len(size)
    at = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    column = np.arange(BLOCK)
    real = column < size[:, None]
    x = np.zeros((n, BLOCK), np.int32)
    x[real] = flat
    x -= 128
    constant = np.where(real, x == x[:, :1], True).all(1)
    coefs, shift = _lpc(x, real)
    guess = np.zeros((n, BLOCK), np.int32)
    for j in range(LPC_ORDER):
        guess[:, LPC_ORDER:] += coefs[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j]
    guess >>= shift[:, None].astype(np.int32)
    first, second = np.zeros_like(x), np.zeros_like(x)
    first[:, 1:] = x[:, 1:] - x[:, :-1]
    second[:, 2:] = x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2]
    forms = [(0, x, 0), (1, first, 0), (2, second, 0), (LPC_ORDER, x - guess, 9 + PRECISION * LPC_ORDER)]
    cost = np.stack([np.where(real & (column >= order), np.abs(r), 0).sum(1) for order, r, _ in forms])
    form = cost.argmin(0)
    order = np.array([f[0] for f in forms])[form]
    extra = np.array([f[2] for f in forms])[form]
    residual = np.choose(form[:, None], [f[1] for f in forms])
    coded = real & (column >= order[:, None])
    zigzag = np.where(coded, residual << 1 ^ residual >> 31, 0)
    count = coded.sum(1)
    bits = np.stack([(zigzag >> k).sum(1, dtype=np.int64) + (1 + k) * count for k in range(11)])
    k = bits.argmin(0)
    bits = bits.min(0) + 8 * order + extra + 10
    kind = np.where(constant, 0, np.where(bits >= 8 * size, 1, 2))
    body = np.where(kind == 0, 1, np.where(kind == 1, size, -(-bits // 8)))
    heads = [frame_header(int(a), int(b)) for a, b in zip(number, size, strict=True)]
    lead = np.array([len(h) for h in heads])
    starts = np.concatenate([[0], np.cumsum(lead + 1 + body + 2)]).astype(np.int64)
    out_bits = np.zeros(8 * int(starts[-1]), np.uint8)
    inside = starts[:-1] + lead + 1
    rice = np.flatnonzero(kind == 2)

    def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            out_bits[where + j] = value >> (width - 1 - j) & 1

    where = inside[rice] * 8
    for j in range(LPC_ORDER):
        some = order[rice] > j
        put(where[some], x[rice[some], j] & 0xFF, 8)
        where = where + 8 * some
    linear = form[rice] == 3
    lanes = rice[linear]
    put(where[linear], np.full(len(lanes), PRECISION - 1), 4)
    put(where[linear] + 4, shift[lanes], 5)
    for j in range(LPC_ORDER):
        put(where[linear] + 9 + PRECISION * j, coefs[lanes, j] & ((1 << PRECISION) - 1), PRECISION)
    where = where + extra[rice]
    put(where + 6, k[rice], 4)  # method 0 and partition order 0 are zeros
    where = where + 10
    chosen = coded[rice]
    z, kk = zigzag[rice][chosen].astype(np.int64), np.repeat(k[rice], count[rice])
    q = z >> kk
    length = q + 1 + kk
    ends = np.cumsum(length)
    before = np.concatenate([[0], np.cumsum(count[rice])[:-1]]).astype(np.int64)
    base = where - np.concatenate([[0], ends])[before] if len(rice) else where
    stop = np.repeat(base, count[rice]) + ends - length + q
    out_bits[stop] = 1
    for j in range(int(kk.max()) if len(kk) else 0):
        some = kk > j
        out_bits[stop[some] + 1 + j] = z[some] >> (kk[some] - 1 - j) & 1
    out = np.packbits(out_bits)
    kinds = np.where(kind < 2, kind, np.where(form == 3, 32 + LPC_ORDER - 1, 8 + order))
    out[inside - 1] = kinds << 1
    for i, h in enumerate(heads):
        out[starts[i] : starts[i] + len(h)] = np.frombuffer(h, np.uint8)
    out[inside[kind == 0]] = flat[at[kind == 0]] ^ 0x80
    for i in np.flatnonzero(kind == 1).tolist():
        out[inside[i] : inside[i] + size[i]] = flat[at[i] : at[i] + size[i]] ^ 0x80
    sums = crc16(out, starts[:-1], starts[1:] - 2)
    out[starts[1:] - 2], out[starts[1:] - 1] = sums >> 8, sums & 0xFF
    return out, starts


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload, whose bytes are samples above -128."""
    if not payloads:
        return []
    stream, number, size = _frames(payloads)
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    parts, starts = [], [np.zeros(1, np.int64)]
    for i in range(0, len(size), FRAMES):
        some = slice(i, i + FRAMES)
        part, edges = _encode_frames(flat[at[i] : at[min(i + FRAMES, len(size))]], number[some], size[some])
        parts.append(part)
        starts.append(edges[1:] + starts[-1][-1])
    out, starts = np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.concatenate(starts)
    streams, frames_at = [], np.searchsorted(stream, np.arange(len(payloads) + 1))
    for i, payload in enumerate(payloads):
        a, b = int(frames_at[i]), int(frames_at[i + 1])
        sizes = np.diff(starts[a : b + 1])
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min(initial=0)).to_bytes(3, "big") + int(sizes.max(initial=0)).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points = b"".join(
            (f * BLOCK).to_bytes(8, "big") + int(starts[a + f] - starts[a]).to_bytes(8, "big") + int(size[a + f]).to_bytes(2, "big")
            for f in range(0, b - a, -(-(b - a) // POINTS) or 1)
        )
        streams.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + out[starts[a] : starts[b]].tobytes())
    return streams


@lru_cache(maxsize=100_000)
def _parse_header(head: bytes, extra: int) -> int:
    """The block's size. Fails on what isn't the header of a mono 8-bit frame."""
    if head[:2] not in (b"\xff\xf8", b"\xff\xf9") or head[3] & 0xF1 or (head[3] >> 1 & 7) not in (0, 1) or crc8(head[:-1]) != head[-1]:
        raise ValueError("not a sound header of a mono 8-bit frame")
    code = head[2] >> 4
    if code in (6, 7):
        end = len(head) - 1 - extra
        return int.from_bytes(head[end - (1 if code == 6 else 2) : end], "big") + 1
    return SIZES[code]


def _header(buf: np.ndarray, at: int) -> tuple[int, int]:
    """Length of the header at a byte, and its block's size."""
    raw = buf[at : at + 20].tobytes()
    if len(raw) < 6:
        raise ValueError("a stream ends in a header")
    lead, extra = raw[4], (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 2, 0)[raw[2] & 15]
    coded = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    length = 5 + coded + (1, 2)[raw[2] >> 4 == 7] * (raw[2] >> 4 in (6, 7)) + extra
    return length, _parse_header(raw[:length], extra)


class Info:
    """What a stream's metadata says: samples, digest, seek points, and where the frames begin."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, []
        while not last:
            last, kind, size = raw[at] >> 7, raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
            block = raw[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.block, self.most = int.from_bytes(block[2:4], "big"), int.from_bytes(block[7:10], "big") or MOST_FRAME
                self.rate, self.channels, self.bits, self.samples, self.md5 = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, block[18:34]
            elif kind == 3:
                self.points = [(int.from_bytes(block[i : i + 8], "big"), int.from_bytes(block[i + 8 : i + 16], "big")) for i in range(0, size, 18) if block[i : i + 8] != b"\xff" * 8]
            at += 4 + size
        self.frames = at
        if (self.channels, self.bits) != (1, 8):
            raise ValueError("only mono streams of 8-bit samples")


def _decode_lanes(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (a row for each lane) and the bit after each subframe. ``buf`` needs 8 spare bytes at its end."""
    n, width = len(starts), int(sizes.max())
    out = np.zeros((n, width), np.int32)
    kinds = buf[starts] >> 1
    if (buf[starts] & 0x81).any():
        raise ValueError("wasted bits aren't supported")
    pos = (starts.astype(np.int64) + 1) * 8
    signed = buf.view(np.int8)
    for i in np.flatnonzero(kinds == 0).tolist():
        out[i, : sizes[i]] = signed[pos[i] >> 3]
        pos[i] += 8
    for i in np.flatnonzero(kinds == 1).tolist():
        out[i, : sizes[i]] = signed[pos[i] >> 3 : (pos[i] >> 3) + sizes[i]]
        pos[i] += 8 * sizes[i]
    fixed, linear = (kinds >= 8) & (kinds <= 12), kinds >= 32
    if not (fixed | linear | (kinds < 2)).all():
        raise ValueError("a reserved kind of subframe")
    lanes = np.flatnonzero(fixed | linear)
    if not len(lanes):
        return out, pos
    order = np.where(linear, kinds.astype(np.int64) - 31, kinds.astype(np.int64) - 8)
    lanes = lanes[np.argsort(-(sizes - order)[lanes], kind="stable")]  # those still running are always in front
    order, p, size = order[lanes], pos[lanes], sizes[lanes].astype(np.int64)
    most = int(order.max())
    window = buf[:-7].astype(np.uint64)
    for j in range(1, 8):
        window = window << np.uint64(8) | buf[j : len(buf) - 7 + j]

    def ahead(at: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, from the top."""
        return window[at >> 3] << (at & 7).astype(np.uint64)

    def read(mask, width: np.ndarray | int) -> np.ndarray:
        got = (ahead(p[mask]) >> (np.uint64(64) - np.asarray(width).astype(np.uint64))).astype(np.int64)
        p[mask] += width
        return got

    count = size - order
    steps = int(count.max())
    history = np.zeros((most + steps, len(lanes)), np.int32)
    for j in range(most):
        some = order > j
        if some.any():
            history[most - order[some] + j, np.flatnonzero(some)] = signed[p[some] >> 3]
            p[some] += 8
    coefs, shift = np.zeros((max(most, 1), len(lanes)), np.int32), np.zeros(len(lanes), np.int32)
    is_linear = linear[lanes]
    for o, row in [x for x in FIXED.items() if x[0] <= most]:
        coefs[:o, ~is_linear & (order == o)] = np.array(row, np.int32).reshape(-1, 1)
    if is_linear.any():
        precision = read(is_linear, 4) + 1
        shift[is_linear] = read(is_linear, 5)
        every = np.flatnonzero(is_linear)
        for j in range(most):
            some = order[every] > j
            got = read(every[some], precision[some])
            coefs[j, every[some]] = got - ((got >> (precision[some] - 1)) << precision[some])
    all_lanes = np.arange(len(lanes))
    method, parts = read(all_lanes, 2), read(all_lanes, 4)
    if (method > 1).any():
        raise ValueError("a reserved method of coding")
    part = size >> parts
    left = np.zeros(len(lanes), np.int64)
    fresh = part - order
    k, raw_bits = np.zeros(len(lanes), np.uint64), np.full(len(lanes), -1, np.int64)
    escaped = False
    running = np.searchsorted(-count, -np.arange(1, steps + 1), "right").tolist()
    orders = [j for j in range(most) if coefs[j].any()]
    for step, m in enumerate(running):
        while not (some := left[:m] > 0).all():  # a partition begins, maybe an empty one
            due = np.flatnonzero(~some)
            got = read(due, np.where(method[due] == 0, 4, 5))
            escape = got == np.where(method[due] == 0, 15, 31)
            raw_bits[due] = -1
            if escape.any():
                raw_bits[due[escape]] = read(due[escape], 5)
            escaped = bool((raw_bits >= 0).any())
            k[due], left[due], fresh[due] = got, fresh[due], part[due]
        left[:m] -= 1
        at = p[:m]
        w = ahead(at)
        q = _ZEROS[(w >> np.uint64(48)).astype(np.int64)]
        if (q == 16).any() or escaped:
            value = _slow_codes(ahead, at, q, k[:m], raw_bits[:m])
        else:
            kk = k[:m]
            rest = (w << (q + 1).astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - kk)
            value = (q << kk.astype(np.int64)) | rest.astype(np.int64)
            at += q + 1 + kk.astype(np.int64)
            value = value >> 1 ^ -(value & 1)
        if orders:
            guess = coefs[orders[0], :m] * history[most + step - 1 - orders[0], :m]
            for j in orders[1:]:
                guess += coefs[j, :m] * history[most + step - 1 - j, :m]
            value += guess >> shift[:m]
        history[most + step, :m] = value
    turned = np.ascontiguousarray(history.T)
    for i, (lane, o, s) in enumerate(zip(lanes.tolist(), order.tolist(), size.tolist(), strict=True)):
        out[lane, :s] = turned[i, most - o : most - o + s]
    pos[lanes] = p
    return out, pos


def _slow_codes(ahead, at: np.ndarray, q: np.ndarray, k: np.ndarray, raw_bits: np.ndarray) -> np.ndarray:
    """One residual of each lane where a quotient is long or a partition is not coded; ``at`` moves on."""
    raw = raw_bits >= 0
    q = np.where(raw, 0, q)
    more = np.flatnonzero(q == 16)
    while len(more):
        zeros = _ZEROS[(ahead(at[more] + q[more]) >> np.uint64(48)).astype(np.int64)]
        q[more] += zeros
        more = more[zeros == 16]
    kk = k.astype(np.int64)
    rest = (ahead(at + q + 1) >> np.uint64(1) >> (np.uint64(63) - k)).astype(np.int64)
    value = q << kk | rest
    value = value >> 1 ^ -(value & 1)
    width = np.maximum(raw_bits, 0)
    plain = (ahead(at) >> np.uint64(1) >> (np.uint64(63) - width.astype(np.uint64))).astype(np.int64)
    plain -= np.where(width > 0, plain >> np.maximum(width - 1, 0), 0) << width
    at += np.where(raw, width, q + 1 + kk)
    return np.where(raw, plain, value)


def decode(streams: list[bytes]) -> list[list[bytes]]:
    """The blocks of each stream as 8-bit payload bytes, in order. Raises where a checksum doesn't hold."""
    infos = [Info(x) for x in streams]
    buf = np.frombuffer(b"".join(streams) + b"\0" * 16, np.uint8)
    base = np.concatenate([[0], np.cumsum([len(x) for x in streams])]).astype(np.int64)
    blocks: list[list[bytes]] = [[] for _ in streams]
    seekable = [i for i, x in enumerate(infos) if _covers(x)]
    owner, starts, ends = [], [], []
    for i in seekable:
        offsets = [o for _, o in infos[i].points]
        owner += [i] * len(offsets)
        starts += [base[i] + infos[i].frames + o for o in offsets]
        ends += [base[i] + infos[i].frames + o for o in offsets[1:]] + [base[i + 1]] * bool(offsets)
    for k in range(0, len(starts), FRAMES):
        first, last = starts[k], ends[min(k + FRAMES, len(starts)) - 1]
        some = [np.array(x[k : k + FRAMES], np.int64) - first for x in (starts, ends)]
        rows, _ = _decode_frames(buf[first : last + 16], *some)
        for i, row in zip(owner[k : k + FRAMES], rows, strict=True):
            blocks[i].append(row)
    for i in set(range(len(streams))) - set(seekable):
        at, held = int(base[i]) + infos[i].frames, 0
        while held < infos[i].samples:
            (row,), size = _decode_frames(buf[at : at + infos[i].most + 16], np.zeros(1, np.int64), None)
            at += size
            blocks[i].append(row)
            held += len(row)
    for info, parts in zip(infos, blocks, strict=True):
        whole = b"".join(parts)
        if len(whole) != info.samples or info.md5 not in (b"\0" * 16, hashlib.md5((np.frombuffer(whole, np.uint8) ^ 0x80).tobytes()).digest()):
            raise ValueError("samples don't fit the stream's digest")
    return blocks


def _covers(info: Info) -> bool:
    """Whether each frame has a seek point: points of fixed blocks one after the other from 0 on."""
    firsts = [a for a, _ in info.points]
    step = firsts[1] if len(firsts) > 1 else max(1, info.samples)
    return firsts == list(range(0, info.samples, step)) and step <= info.block


def _decode_frames(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray | None):
    heads = [_header(buf, int(a)) for a in starts]
    lead, sizes = (np.array(x, np.int64) for x in zip(*heads, strict=True))
    samples, pos = _decode_lanes(buf, starts + lead, sizes)
    stops = -(-pos // 8)
    if ends is not None and (stops + 2 != ends).any():
        raise ValueError("a frame doesn't end where the next begins")
    said = buf[stops].astype(np.uint16) << 8 | buf[stops + 1]
    if (crc16(buf, starts, stops) != said).any():
        raise ValueError("a frame's checksum doesn't hold")
    payload = (samples + 128).astype(np.uint8)
    return [payload[i, :s].tobytes() for i, s in enumerate(sizes.tolist())], int(stops[-1]) + 2


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zeros up to a positive multiple of 64; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))


def _grouped(batch: pa.RecordBatch, at: int, size: int) -> Iterator[pa.RecordBatch]:
    step = max(1, batch.num_rows * size // max(1, batch.column(at).nbytes))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's payload as a FLAC stream. Other columns aren't read."""
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _grouped(batch, 1, 2 << 20):
                texts = part.column(1).to_pylist()
                media = encode([payload_of(x) for x in texts])
                sizes = [len((x or "").encode("utf-8", "surrogatepass")) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return src.mapInArrow(run, src.select("doc_id").schema.add("n_bytes", "long").add("media", "binary"))


def _decoded(streams: list[bytes | None]) -> list[tuple[list[bytes] | None, str | None]]:
    """The blocks of each stream, or what is wrong with it."""
    try:
        real = iter(decode([x for x in streams if x is not None]))
        return [(None, None) if x is None else (next(real), None) for x in streams]
    except (ValueError, IndexError) as wrong:
        if len(streams) == 1:
            return [(None, str(wrong) or "not a sound stream")]
        return [y for x in streams for y in _decoded([x])]


def with_pcm(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, media_bytes, media_sha256, sample_offset, pcm, problem``: the blocks of samples of each stream, and
    the place in the stream of each block's first sample; columns named in ``carry`` stand behind the identifier.

    A null stream has nulls. So has one that isn't sound, or isn't mono of 8 bits, but for its size and digest;
    ``problem`` says why.
    """
    prepare(media.sparkSession)
    src = media.select(F.col(id_col).alias("doc_id"), *carry, F.col(media_col).alias("media"))
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.string()]
    names = [*src.columns[:-1], "media_bytes", "media_sha256", "sample_offset", "pcm", "problem"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            for part in _grouped(batch, at, 2 << 20):
                rows = []
                streams = part.column(at).to_pylist()
                for raw, (blocks, problem) in zip(streams, _decoded(streams), strict=True):
                    size, digest = (None, None) if raw is None else (len(raw), hashlib.sha256(raw).hexdigest())
                    offsets = None if blocks is None else np.cumsum([0, *map(len, blocks)])[:-1].tolist()
                    rows.append((size, digest, offsets, blocks, problem))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *columns], names)

    schema = src.drop("media").schema.add("media_bytes", "long").add("media_sha256", "string")
    return src.mapInArrow(run, schema.add("sample_offset", ArrayType(LongType())).add("pcm", ArrayType(BinaryType())).add("problem", "string"))


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``doc_id, block, sample_offset, pcm``: a row for each block. A null or unsound stream has none."""
    blocks = with_pcm(df, id_col, media_col).select("doc_id", F.posexplode(F.arrays_zip("sample_offset", "pcm")).alias("block", "of"))
    return blocks.select("doc_id", F.col("block").cast("long").alias("block"), "of.sample_offset", "of.pcm")


def samples(first: int, count: int) -> Column:
    """So many samples from a place on, of a row of ``with_pcm``: only the blocks that hold them are touched."""
    blocks = F.filter(F.arrays_zip("sample_offset", "pcm"), lambda b: (b["sample_offset"] < first + count) & (b["sample_offset"] + F.octet_length(b["pcm"]) > first))
    joined = F.aggregate(blocks, F.lit(b""), lambda held, b: F.concat(held, b["pcm"]))
    return F.substring(joined, F.lit(first + 1) - F.try_element_at(blocks, F.lit(1))["sample_offset"].cast("int"), F.lit(count))


def describe(pcm: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` of rows of
    ``with_pcm`` that carry ``n_bytes``; nulls where there are no blocks."""
    prepare(pcm.sparkSession)
    new = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]

    def one(blocks: list[bytes] | None) -> tuple:
        if blocks is None:
            return None, None, None, None
        digest, size, peak, energy, crossings, before, tail = hashlib.sha256(), 0, 0, 0, 0, np.zeros(0, np.int64), b""
        for i in range(0, len(blocks), FRAMES):
            raw = b"".join(blocks[i : i + FRAMES])
            s = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
            negative = np.concatenate([before, s]) < 0
            crossings += int(np.count_nonzero(negative[1:] != negative[:-1]))
            peak, energy, before, tail, size = max(peak, int(np.abs(s).max())), energy + int(s @ s), s[-1:], (tail + raw)[-64:], size + len(raw)
            digest.update(raw)
        return size, digest.hexdigest(), zlib.crc32(tail), f"rate={RATE};blocks={len(blocks)};peak={peak};energy={energy};crossings={crossings}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _grouped(batch, 4, 8 << 20):
                rows = [one(blocks.as_py()) for blocks in part.column(4)]
                columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), new, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *columns], ["doc_id", "n_bytes", "media_bytes", "media_sha256", *[name for name, _ in new]])

    src = pcm.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "pcm")
    schema = src.drop("pcm").schema
    for name, kind in new:
        schema = schema.add(name, "long" if kind == pa.int64() else "string")
    out = src.mapInArrow(run, schema)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
