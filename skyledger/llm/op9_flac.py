"""Operator 9: media columns as FLAC, written and read back without a codec library.

``to_flac`` stores bytes losslessly as 8-bit mono samples (byte minus 128) in frames of 576: the
best fixed linear predictor, or a given one, Rice-coded residuals, header and frame checksums, an
MD5 of the samples and a seek table. ``from_flac`` reads any such stream: constant, verbatim,
fixed and LPC subframes, Rice partitions and escapes; it checks both checksums of every frame and
the MD5, and gives the samples with the offsets of their blocks.

Both work on many frames at once in numpy. A reader can only find a frame's end by decoding it,
so each seek point starts a lane, and all lanes of a batch decode their next sample together.

``write_media``, ``read_media`` and ``write_pcm`` keep streams and PCM blocks as tables. The registered
query hands each stream on as a column in place of a table: text hardly shrinks as sound, and a table
of streams takes 1.6 times the bytes of compressed documents.

Defined results: a null text is an empty one; payloads are filled with byte 255 to a positive
multiple of 576, so there is always a frame; equal texts give equal media; a damaged stream raises.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import documents, text_slices

BLOCK = 576
#: Fixed values of the format: sample rate and the codes of block size, rate and sample size in a frame header.
RATE, SIZE_AND_RATE, MONO_8 = 8000, 0x24, 0x02
POLY_8, POLY_16 = 0x07, 0x8005
BLOCK_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}


class Checksum:
    """CRC of many byte ranges at once: a CRC is the exclusive or of what each byte adds, which
    hangs on the byte and on how many follow it."""

    def __init__(self, poly: int, bits: int):
        self.bits, self.mask = bits, (1 << bits) - 1
        row = np.arange(256, dtype=np.uint32) << (bits - 8)
        for _ in range(8):
            row = np.where(row >> (bits - 1) & 1, (row << 1) ^ poly, row << 1) & self.mask
        self.first, self.rows = row.astype(np.uint16), [row.astype(np.uint16)]
        self.table = np.array(self.rows)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``data`` as uint8; the ranges are not empty, in order, and apart."""
        size = ends - starts
        while len(self.rows) < size.max():
            last = self.rows[-1].astype(np.uint32)
            self.rows.append((((last << 8) & self.mask) ^ self.first[last >> (self.bits - 8)]).astype(np.uint16))
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows)
        at = np.cumsum(size) - size
        n = int(size.sum())
        after = np.repeat(at + size - 1, size) - np.arange(n)
        where = np.repeat(starts - at, size) + np.arange(n)
        return np.bitwise_xor.reduceat(self.table.ravel()[after * 256 + data[where]], at)


def fold(residual: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones, small ones first."""
    return (residual << 1) ^ (residual >> 31)


def number_bytes(n: int) -> bytes:
    """A frame number as the format spells it."""
    if n < 0x80:
        return bytes([n])
    out = []
    while n >= 1 << (6 - len(out)):
        out.append(0x80 | n & 0x3F)
        n >>= 6
    lead = (0xFF << (7 - len(out))) & 0xFF
    return bytes([lead | n, *reversed(out)])


class Writer:
    """``predictor``: None picks the best fixed one of each frame; else (coefficients, shift) of an
    LPC predictor for all frames."""

    def __init__(self, seek_every: int = 4, predictor: tuple[list[int], int] | None = None):
        self.seek_every, self.predictor = seek_every, predictor
        self.crc8, self.crc16 = Checksum(POLY_8, 8), Checksum(POLY_16, 16)

    def _residuals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Folded residuals (the warm-up samples' places hold 0) and each frame's order."""
        n = len(x)
        if self.predictor:
            coefs, shift = self.predictor
            order = len(coefs)
            guess = sum(c * x[:, order - 1 - k : x.shape[1] - 1 - k] for k, c in enumerate(coefs)) >> shift
            u = np.zeros(x.shape, dtype=np.int32)
            u[:, order:] = fold(x[:, order:] - guess)
            return u, np.full(n, order)
        best, order, d = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64), x
        u = np.zeros(x.shape, dtype=np.int32)
        for k in range(3):
            if k:
                d = np.diff(d, axis=1)
            cost = np.abs(d).sum(axis=1, dtype=np.int64)
            better = np.flatnonzero(cost < best)
            best[better], order[better] = cost[better], k
            u[better, k:] = fold(d[better])
        for k in (1, 2):
            rows = np.flatnonzero(order == k)
            u[rows, :k] = 0
        return u, order

    def encode(self, payloads: list[bytes]) -> list[bytes]:
        frames = np.array([len(p) // BLOCK for p in payloads], dtype=np.int64)
        raw = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK)
        x = raw.astype(np.int32) - 128
        u, order = self._residuals(x)
        n_codes = BLOCK - order
        mean = u.sum(axis=1, dtype=np.int64) / n_codes
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
        q = u >> k[:, None].astype(np.int32)
        coded = np.arange(BLOCK)[None, :] >= order[:, None]
        size = np.where(coded, q + 1 + k[:, None], 0)
        head = 1 + order  # bytes before the residual: the subframe's type, the warm-up samples
        if self.predictor:
            coefs, shift = self.predictor
            extra = "".join([f"{14:04b}", f"{shift & 31:05b}", *[f"{c & 0x7FFF:015b}" for c in coefs]])
        else:
            extra = ""
        bits = len(extra) + 10 + size.sum(axis=1)
        constant = (x == x[:, :1]).all(axis=1)
        verbatim = ~constant & (head + (bits + 7) // 8 > BLOCK + 1)
        rice = ~constant & ~verbatim
        body = np.where(constant, 2, np.where(verbatim, BLOCK + 1, head + (bits + 7) // 8))
        number = np.concatenate([np.arange(f) for f in frames])
        spelled = [number_bytes(i) for i in range(int(frames.max()))]
        long = np.array([len(b) for b in spelled])[number]
        total = 4 + long + 1 + body + 2
        starts = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), dtype=np.uint8)
        for j, b in enumerate((0xFF, 0xF8, SIZE_AND_RATE, MONO_8)):
            out[starts + j] = b
        flat, offset = np.frombuffer(b"".join(spelled), dtype=np.uint8), np.cumsum([0, *[len(b) for b in spelled]])[:-1]
        for j in range(int(long.max())):
            has = long > j
            out[starts[has] + 4 + j] = flat[offset[number[has]] + j]
        at = starts + 5 + long
        out[at - 1] = self.crc8.of(out, starts, at - 1)
        out[at[constant] + 1] = x[constant, 0].astype(np.int8).view(np.uint8)
        out[at[verbatim]] = 1 << 1
        if verbatim.any():
            out[(at[verbatim] + 1)[:, None] + np.arange(BLOCK)] = x[verbatim].astype(np.int8).view(np.uint8)
        out[at[rice]] = (32 + order[rice] - 1 if self.predictor else 8 + order[rice]) << 1
        for o in range(1, int(order.max()) + 1):
            rows = np.flatnonzero(rice & (order >= o))
            out[at[rows] + o] = x[rows, o - 1].astype(np.int8).view(np.uint8)
        self._residual_bits(out, np.flatnonzero(rice), at + head, u, q, k, size, coded, extra)
        ends = starts + total
        crc = self.crc16.of(out, starts, ends - 2)
        out[ends - 2], out[ends - 1] = crc >> 8, crc & 0xFF
        return self._streams(payloads, frames, starts, total, out)

    @staticmethod
    def _residual_bits(out, rows, at, u, q, k, size, coded, extra) -> None:
        if not len(rows):
            return
        span = (len(extra) + 10 + size[rows].sum(axis=1) + 7) // 8
        base = np.cumsum(span) - span
        bits = np.zeros(8 * int(span.sum()), dtype=np.uint8)
        lead = 8 * base
        for j, c in enumerate(extra):
            if c == "1":
                bits[lead + j] = 1
        for j in range(4):
            bits[lead + len(extra) + 6 + j] = k[rows] >> (3 - j) & 1
        begin = lead[:, None] + len(extra) + 10 + np.cumsum(size[rows], axis=1) - size[rows]
        stop = begin + q[rows]
        for value in np.unique(k[rows]).tolist():
            pick = coded[rows] & (k[rows] == value)[:, None]
            places, codes = stop[pick], u[rows][pick]
            bits[places] = 1
            for j in range(value):
                bits[places + value - j] = codes >> j & 1
        packed = np.packbits(bits)
        out[np.repeat(at[rows] - base, span) + np.arange(len(packed))] = packed

    def _streams(self, payloads, frames, starts, total, out) -> list[bytes]:
        media, first, data = [], 0, out.tobytes()
        for payload, n in zip(payloads, frames.tolist(), strict=True):
            a, sizes = starts[first : first + n], total[first : first + n]
            samples = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()
            info = (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big")
            points = b"".join((BLOCK * i).to_bytes(8, "big") + int(a[i] - a[0]).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for i in range(0, n, self.seek_every))
            media.append(
                b"fLaC\x00\x00\x00\x22" + 2 * BLOCK.to_bytes(2, "big") + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
                + info + hashlib.md5(samples).digest() + b"\x83" + len(points).to_bytes(3, "big") + points + data[int(a[0]) : int(a[-1] + sizes[-1])]
            )
            first += n
        return media


@dataclass
class Decoded:
    """``samples`` as signed bytes; ``blocks`` has (first sample, samples, byte in the stream)."""

    samples: bytes
    blocks: list[tuple[int, int, int]] = field(default_factory=list)


class Reader:
    def __init__(self):
        self.crc8, self.crc16 = Checksum(POLY_8, 8), Checksum(POLY_16, 16)
        self.small = [int(v) for v in self.crc8.first]
        zeros = np.full(1 << 16, 16, dtype=np.int64)
        for k in range(16):
            zeros[1 << k : 2 << k] = 15 - k
        self.zeros = zeros  # leading zeros of 16 bits

    @staticmethod
    def _metadata(stream: bytes) -> tuple[int, bytes, list[tuple[int, int]], int]:
        """Samples in all, their MD5, the seek points, and where frames begin."""
        if stream[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, points, info = 4, False, [], None
        while not last:
            kind, size = stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
            last, body = bool(stream[at] & 0x80), stream[at + 4 : at + 4 + size]
            if kind == 0:
                info = body
            elif kind == 3:
                points = [(int.from_bytes(body[k : k + 8], "big"), int.from_bytes(body[k + 8 : k + 16], "big")) for k in range(0, size, 18)]
            at += 4 + size
        if info is None:
            raise ValueError("the stream has no description")
        packed = int.from_bytes(info[10:18], "big")
        if packed >> 41 & 7 or (packed >> 36 & 31) + 1 != 8:
            raise ValueError("only one channel of 8 bits is read")
        points = sorted({(s, b) for s, b in points if s != (1 << 64) - 1} | {(0, 0)})
        return packed & ((1 << 36) - 1), info[18:34], points, at

    def _frame(self, data: bytes, at: int) -> tuple[int, int]:
        """Check a frame header; the block size, and where the subframe begins."""
        if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
            raise ValueError("no frame begins here")
        code, rate = data[at + 2] >> 4, data[at + 2] & 15
        lead, pos = data[at + 4], at + 5
        while lead & 0xC0 == 0xC0:
            lead, pos = (lead << 1) & 0xFF, pos + 1
        if code in (6, 7):
            n = int.from_bytes(data[pos : pos + code - 5], "big") + 1
            pos += code - 5
        else:
            n = BLOCK_SIZES[code]
        pos += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        crc = 0
        for b in data[at:pos]:
            crc = self.small[crc ^ b]
        if crc != data[pos]:
            raise ValueError("a frame header's checksum is wrong")
        return n, pos + 1

    def decode(self, streams: list[bytes]) -> list[Decoded]:
        heads = [self._metadata(s) for s in streams]
        base = np.cumsum([0, *map(len, streams)])[:-1].tolist()
        data = b"".join(streams) + bytes(16)
        wide = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        window = wide[:-4] << 32 | wide[1:-3] << 24 | wide[2:-2] << 16 | wide[3:-1] << 8 | wide[4:]
        # a lane: stream, next sample, next byte, the sample where the next lane begins
        lanes: list[list[int]] = []
        for k, (total, _, points, begin) in enumerate(heads):
            bounds = [s for s, _ in points if s < total] + [total]
            lanes += [[k, s, base[k] + begin + b, e] for (s, b), e in zip(points, bounds[1:], strict=False) if s < e]
        pieces: list[list[tuple[int, bytes, int]]] = [[] for _ in streams]
        bytes_ = np.frombuffer(data, dtype=np.uint8)
        while lanes:
            groups = defaultdict(list)
            for lane in lanes:
                n, at = self._frame(data, lane[2])
                kind = data[at] >> 1
                if data[at] & 1:
                    raise ValueError("wasted bits are not read")
                groups[(n, kind)].append((lane, at + 1))
            for (n, kind), members in groups.items():
                samples, ends = self._subframes(data, window, n, kind, np.array([a for _, a in members]))
                starts = np.array([lane[2] for lane, _ in members])
                order = np.argsort(starts)
                crc = self.crc16.of(bytes_, starts[order], ends[order])
                if (crc != (wide[ends[order]] << 8 | wide[ends[order] + 1])).any():
                    raise ValueError("a frame's checksum is wrong")
                rows = samples.astype(np.int8)
                for (lane, _), row, end in zip(members, rows, ends.tolist(), strict=True):
                    pieces[lane[0]].append((lane[1], row.tobytes(), lane[2] - base[lane[0]]))
                    lane[1], lane[2] = lane[1] + n, end + 2
            lanes = [lane for lane in lanes if lane[1] < lane[3]]
        out = []
        for (total, md5, _, _), found in zip(heads, pieces, strict=True):
            found.sort()
            samples = b"".join(p for _, p, _ in found)[:total]
            if len(samples) != total or md5 != bytes(16) and hashlib.md5(samples).digest() != md5:
                raise ValueError("the samples are not those that were stored")
            out.append(Decoded(samples, [(s, len(p), b) for s, p, b in found]))
        return out

    def _subframes(self, data: bytes, window: np.ndarray, n: int, kind: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples of subframes of one kind, and the bytes where they end."""
        signed = np.frombuffer(data, dtype=np.int8)
        if kind == 0:
            return np.repeat(signed[at][:, None], n, axis=1), at + 1
        if kind == 1:
            return signed[at[:, None] + np.arange(n)], at + n
        lpc = kind >= 32
        order = kind - 31 if lpc else kind - 8
        if not (lpc or 0 <= order <= 4):
            raise ValueError("a reserved kind of subframe")
        x = np.zeros((len(at), n), dtype=np.int64)
        x[:, :order] = signed[at[:, None] + np.arange(order)]
        bit = 8 * (at + order)
        if lpc:
            precision = self._bits(window, bit, 4) + 1
            shift = self._signed(self._bits(window, bit + 4, 5), 5)
            coefs, bit = np.zeros((len(at), order), dtype=np.int64), bit + 9
            for k in range(order):
                coefs[:, k] = self._signed(self._bits(window, bit, precision), precision)
                bit = bit + precision
        bit = self._residual(window, x, n, order, bit)
        if lpc:
            for j in range(order, n):
                guess = (coefs * x[:, j - order : j][:, ::-1]).sum(axis=1)
                x[:, j] += np.where(shift >= 0, guess >> np.maximum(shift, 0), guess << np.maximum(-shift, 0))
        else:
            for level in range(order - 1, -1, -1):
                begin = np.diff(x[:, :order], n=level, axis=1)[:, -1] if level else x[:, order - 1]
                x[:, order:] = begin[:, None] + np.cumsum(x[:, order:], axis=1)
        return x, (bit + 7) >> 3

    @staticmethod
    def _bits(window: np.ndarray, bit: np.ndarray, n) -> np.ndarray:
        """Up to 32 bits from each place."""
        return (window[bit >> 3] << (bit & 7) & 0xFFFFFFFFFF) >> (40 - n) & ((1 << n) - 1)

    @staticmethod
    def _signed(value: np.ndarray, n) -> np.ndarray:
        return value - ((value >> (n - 1) & 1) << n)

    def _residual(self, window: np.ndarray, x: np.ndarray, n: int, order: int, bit: np.ndarray) -> np.ndarray:
        """Rice codes of all rows of ``x`` from ``order`` on, side by side; where they end."""
        method = self._bits(window, bit, 2)
        if (method > 1).any():
            raise ValueError("a reserved kind of residual")
        width = 4 + method
        parts = self._bits(window, bit + 2, 4)
        bit = bit + 6
        each = n >> parts
        k, raw = np.zeros_like(bit), np.full_like(bit, -1)
        zeros, out = self.zeros, np.empty((n, len(bit)), dtype=np.int64)
        boundaries = set(range(0, n, int(each.min()))) | {order}
        smooth = True
        for j in range(order, n):
            if j in boundaries:
                new = np.flatnonzero((j == order) | (j % each == 0))
                k[new] = self._bits(window, bit[new], width[new])
                bit[new] += width[new]
                escaped = new[k[new] == (1 << width[new]) - 1]
                raw[new] = -1
                raw[escaped] = self._bits(window, bit[escaped], 5)
                bit[escaped] += 5
                # a quotient of up to 15 zeros, its end and the low bits must fit in the window
                smooth = bool((raw < 0).all() and (k <= 24).all())
                mask = (1 << k) - 1
            word = window[bit >> 3] << (bit & 7) & 0xFFFFFFFFFF
            q = zeros[word >> 24]
            if (q == 16).any() or not smooth:
                out[j], bit = self._slowly(window, bit, k, raw)
                continue
            used = q + k + 1
            u = q << k | word >> (40 - used) & mask
            out[j] = (u >> 1) ^ -(u & 1)
            bit = bit + used
        x[:, order:] = out[order:].T
        return bit

    def _slowly(self, window: np.ndarray, bit: np.ndarray, k: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One code of each row, with long runs of zeros and escaped ones."""
        plain = raw < 0
        q, going = np.zeros_like(bit), plain.copy()
        while going.any():
            more = self.zeros[self._bits(window, bit, 16)]
            q += np.where(going, more, 0)
            bit = bit + np.where(going, more, 0)
            going &= more == 16
        bit = bit + plain
        u = q << k | self._bits(window, bit, np.where(plain, k, 0))
        value = np.where(plain, (u >> 1) ^ -(u & 1), np.where(raw > 0, self._signed(self._bits(window, bit, np.maximum(raw, 1)), np.maximum(raw, 1)), 0))
        return value, bit + np.where(plain, k, raw)


def fill(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the block."""
    return text + b"\xff" * (-len(text) % BLOCK or (0 if text else BLOCK))


def to_flac(docs: DataFrame, seek_every: int = 4) -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text's bytes as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(seek_every)
        for batch in batches:
            for part in text_slices(batch, 2 << 20):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                media = writer.encode([fill(t) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(samples: np.ndarray) -> str:
    """Least and greatest sample, their sum, crossings of zero and the energy of differences."""
    wide = samples.astype(np.int64)
    step = np.diff(wide)
    crossings = int(((wide[1:] < 0) != (wide[:-1] < 0)).sum())
    return f"min={wide.min()};max={wide.max()};sum={wide.sum()};crossings={crossings};energy={int((step * step).sum())}"


def from_flac(stored: DataFrame) -> DataFrame:
    """``stored`` with ``payload``, ``feature`` and ``blocks`` (``first_sample, n_samples,
    byte_at``), all from the decoded ``media``."""
    kind = pa.list_(pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int32()), ("byte_at", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for part in text_slices(batch, 4 << 20, "media"):
                found = reader.decode(part.column("media").to_pylist())
                samples = [np.frombuffer(d.samples, dtype=np.int8) for d in found]
                payloads = [(s.view(np.uint8) ^ 0x80).tobytes() for s in samples]
                blocks = [[{"first_sample": s, "n_samples": n, "byte_at": b} for s, n, b in d.blocks] for d in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(payloads, pa.binary()), pa.array([feature(s) for s in samples], pa.string()), pa.array(blocks, kind)],
                    names=[*part.schema.names, "payload", "feature", "blocks"],
                )

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stored.schema)}, payload binary, feature string, blocks array<struct<first_sample:bigint,n_samples:int,byte_at:bigint>>"
    return stored.mapInArrow(run, schema)


def write_media(docs: DataFrame, path: str, seek_every: int = 4) -> None:
    """Store every whole text's stream at ``path``, a Parquet table of ``doc_id, n_bytes, media``."""
    to_flac(docs, seek_every).write.option("compression", "none").parquet(path)  # a stream hardly shrinks any more


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """What ``from_flac`` finds in the streams stored at ``path``."""
    return from_flac(spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path))


def write_pcm(decoded: DataFrame, path: str) -> None:
    """Store the decoded samples at ``path``, a row for each block with the offset of its first sample."""
    pcm_blocks(decoded).write.option("compression", "zstd").parquet(path)


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """A row for each block of samples: ``doc_id, first_sample, n_samples, byte_at, pcm``."""
    return decoded.select("doc_id", "payload", F.explode("blocks").alias("b")).select(
        "doc_id", "b.*", F.expr("substring(payload, cast(b.first_sample as int) + 1, b.n_samples)").alias("pcm")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_flac(to_flac(documents(spark, sf_dir))).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("blocks").alias("n_blocks"),
    )
