"""Operator 3, media columns: MPEG audio.

`parse` walks the bytes of an MPEG audio file. It reads ID3v2, ID3v1 and APEv2 tags, finds frame headers (and finds
them again after damage: a header counts where the next one follows its length, or the audio ends), verifies frame
checksums of layers I and III, reads Xing / Info and VBRI tables, and keeps the byte offset of every frame, which makes
durations and seeks exact without the tables. Runs of equal headers are read at one step, so the work in Python
grows with the changes of header rather than with frames.

`write` stores bytes losslessly as a layer I mono stream: each frame has 16 subbands of 12 samples at 8 bits, 192
bytes. The sample code 255 is not allowed in layer I; UTF-8 never has it.

Defined results: null and empty texts are 192 spaces. Bytes that are no MPEG audio parse to no frames and duration 0.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, table

#: Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index, and Hz by sampling index.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
#: Our streams: MPEG-1 layer I with checksums, 160 kbit/s, 32 kHz, mono: 240 bytes a frame.
HEADER = bytes([0xFF, 0xFE, 0x58, 0xC0])
UNIT, LENGTH, BODY = 192, 240, 34
ALLOCATION = bytes([0x77] * 8 + [0] * 8)
SCALE = b"\x00" * 12


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbits: int
    hertz: int
    padding: int
    mode: int
    extension: int

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12000 * self.kbits // self.hertz + self.padding) * 4
        return (72000 if self.layer == 3 and self.version != 1 else 144000) * self.kbits // self.hertz + self.padding

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 1 else 1152

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        return (17 if self.mode == 3 else 32) if self.version == 1 else (9 if self.mode == 3 else 17)

    @property
    def checked(self) -> int | None:
        """Bits after the checksum that it covers; None where that depends on the frame (layer II)."""
        if self.layer == 3:
            return 8 * self.side
        if self.layer == 1:
            shared = 4 * (self.extension + 1) if self.mode == 1 else 32
            return 4 * (32 if self.mode == 3 else shared + 32)
        return None


def header(word: bytes) -> Header | None:
    """A frame's four header bytes; None if they are none, or of free format."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(word[1] >> 3 & 3)
    layer, rate, hertz = 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    return Header(version, layer, not word[1] & 1, KBITS[1 if version == 1 else 2, layer][rate], HERTZ[version][hertz], word[2] >> 1 & 1, word[3] >> 6, word[3] >> 4 & 3)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        x = i << 8
        for _ in range(8):
            x = (x << 1) ^ (0x8005 if x & 0x8000 else 0)
        out.append(x & 0xFFFF)
    return out


CRC = _crc_table()


def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 of the standard (polynomial 0x8005, start 0xFFFF); bits: how many of data count."""
    x, whole = 0xFFFF, len(data) if bits is None else bits // 8
    for b in data[:whole]:
        x = (x << 8 & 0xFFFF) ^ CRC[x >> 8 ^ b]
    for i in range(0 if bits is None else bits % 8):
        x = (x << 1 & 0xFFFF) ^ (0x8005 if (x >> 15) ^ (data[whole] >> 7 - i & 1) else 0)
    return x


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict | None = None
    runs: list[tuple[Header, int]] = field(default_factory=list)  # headers and how many frames have them
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    info_frames: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    crc_unknown: int = 0
    skipped: int = 0
    resyncs: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples * n for h, n in self.runs)

    @property
    def duration_us(self) -> int:
        """Exact microseconds, rounded down once for each sampling rate."""
        by: dict[int, int] = {}
        for h, n in self.runs:
            by[h.hertz] = by.get(h.hertz, 0) + h.samples * n
        return sum(n * 1_000_000 // hertz for hertz, n in by.items())

    def seek(self, us: int) -> int:
        """Byte offset of the frame that plays at this time; of the last one beyond the end."""
        k = 0
        for h, n in self.runs:
            each = h.samples * 1_000_000
            if us * h.hertz < each * n:
                return int(self.offsets[k + us * h.hertz // each])
            us -= each * n // h.hertz
            k += n
        return int(self.offsets[-1]) if len(self.offsets) else 0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """End of an ID3v2 tag at the start; 0 if there is none."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    major, end = data[3], 10 + _synchsafe(data[6:10])
    body = data[10:end]
    if data[5] & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if data[5] & 0x40 and len(body) >= 4:
        at = _synchsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4])
    name, wide = (3, 3) if major == 2 else (4, 4)
    while at + name + wide <= len(body) and body[at]:
        key = body[at : at + name].decode("latin-1")
        raw = body[at + name : at + name + wide]
        size = _synchsafe(raw) if major == 4 else int.from_bytes(raw)
        at += name + wide + (0 if major == 2 else 2)
        value, at = body[at : at + size], at + size
        if key[0] == "T" and value:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
            tags[key] = value[1:].decode(code, "replace").rstrip("\0")
    return min(len(data), end + (10 if data[5] & 0x10 else 0))


def _trailing(data: bytes, start: int, tags: dict[str, str]) -> int:
    """Where the audio ends: before ID3v1 and APEv2 tags."""
    end = len(data)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(f"id3v1:{key}", text)
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
        at, foot = end - size, end - 32
        if at >= start:
            for _ in range(count):
                if at + 8 > foot:
                    break
                length = struct.unpack("<I", data[at : at + 4])[0]
                key, _, _ = data[at + 8 : foot].partition(b"\0")
                at += 9 + len(key)
                tags[f"ape:{key.decode('latin-1')}"] = data[at : at + length].decode("utf-8", "replace")
                at += length
            end = end - size - (32 if flags >> 31 else 0)
    return max(start, end)


def _vbr(frame: bytes, h: Header) -> dict | None:
    """The Xing / Info or VBRI table of a first frame."""
    for at in {4 + 2 * h.protected + h.side, 4 + h.side, 36}:
        kind = frame[at : at + 4]
        if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, at = int.from_bytes(frame[at + 4 : at + 8]), at + 8
            out = {"kind": kind.decode(), "frames": None, "bytes": None, "toc": None, "quality": None}
            for bit, key, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit and len(frame) >= at + size:
                    out[key] = list(frame[at : at + 100]) if key == "toc" else int.from_bytes(frame[at : at + 4])
                    at += size
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, quality, size, frames, entries, scale, width, each = struct.unpack(">HHHIIHHHH", frame[40:62])
        raw = frame[62 : 62 + entries * width]
        toc = [int.from_bytes(raw[i : i + width]) * scale for i in range(0, len(raw), width or 1)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "quality": quality, "frames_per_entry": each}
    return None


def parse(data: bytes) -> Audio:
    out = Audio()
    at = _id3v2(data, out.tags)
    end = _trailing(data, at, out.tags)
    view = np.frombuffer(data, dtype=np.uint8)
    offsets, first, lost = [], True, False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        size = h.length if h else 0
        follows = h and (at + size == end or (at + size + 4 <= end and header(data[at + size : at + size + 4])))
        if not h or at + size > end or (not follows and (lost or first)):
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.resyncs += not lost
            lost = True
            out.skipped += nxt - at
            at = nxt
            continue
        lost = False
        word = int.from_bytes(data[at : at + 4])
        most = (end - at) // size
        if first and (table := _vbr(data[at : at + size], h)):
            out.vbr, out.info_frames, n = table, 1, 0
            at += size
            first = False
            continue
        block = view[at : at + most * size].reshape(most, size)
        same = (block[:, 0].astype(np.uint32) << 24 | block[:, 1].astype(np.uint32) << 16 | block[:, 2].astype(np.uint32) << 8 | block[:, 3]) == word
        n = most if same.all() else int(np.argmin(same))
        first = False
        if h.protected:
            bits = h.checked
            if bits is None:
                out.crc_unknown += n
            else:
                whole = -(-bits // 8)
                seen, times = np.unique(block[:n, 4 : 6 + whole], axis=0, return_counts=True) if n > 1 else (block[:1, 4 : 6 + whole], [1])
                for row, k in zip(seen, times, strict=True):
                    raw = row.tobytes()
                    good = int.from_bytes(raw[:2]) == crc16(data[at + 2 : at + 4] + raw[2:], 16 + bits)
                    out.crc_good, out.crc_bad = out.crc_good + good * int(k), out.crc_bad + (not good) * int(k)
        out.runs.append((h, n))
        offsets.append(at + size * np.arange(n))
        at += n * size
    out.skipped += max(0, end - at) if lost or at < end else 0
    if offsets:
        out.offsets = np.concatenate(offsets)
    return out


_PREFIX = HEADER + crc16(HEADER[2:] + ALLOCATION).to_bytes(2) + ALLOCATION + SCALE
_SILENT = HEADER + crc16(HEADER[2:] + b"\x00" * 16).to_bytes(2) + b"\x00" * 16
_TAG = b"ID3\x04\x00\x00" + bytes([0, 0, 0, 17]) + b"TSSE" + bytes([0, 0, 0, 7]) + b"\x00\x00\x03gneiss"


def write(payload: bytes) -> bytes:
    """A layer I file whose samples are the payload, a positive multiple of UNIT bytes without 0xFF."""
    n, rest = divmod(len(payload), UNIT)
    if rest or not n:
        raise ValueError(f"payload of {len(payload)} bytes; a positive multiple of {UNIT} is needed")
    frames = np.zeros((n, LENGTH), dtype=np.uint8)
    frames[:, :BODY] = np.frombuffer(_PREFIX, dtype=np.uint8)
    frames[:, BODY : BODY + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
    size = (n + 1) * LENGTH
    toc = bytes(min(255, (LENGTH + (n * i // 100) * LENGTH) * 256 // size) for i in range(100))
    info = (_SILENT.ljust(36, b"\0") + b"Info" + struct.pack(">III", 7, n, size) + toc).ljust(LENGTH, b"\0")
    return _TAG + info + frames.tobytes()


def samples(data: bytes, audio: Audio) -> bytes:
    """The 8-bit samples of a stream that write() made."""
    view = np.frombuffer(data, dtype=np.uint8)
    if len(audio.runs) == 1:
        a = int(audio.offsets[0])
        return view[a : a + len(audio.offsets) * LENGTH].reshape(-1, LENGTH)[:, BODY : BODY + UNIT].tobytes()
    return b"".join(view[a + BODY : a + BODY + UNIT].tobytes() for a in audio.offsets)


def pad(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT))


FIELDS = "layer int, hertz int, frames bigint, samples bigint, duration_us bigint, vbr_kind string, vbr_frames bigint, crc_good bigint, crc_bad bigint, resyncs bigint, skipped bigint, tags map<string,string>, frame_offsets array<bigint>"


def probe(df: DataFrame, column: str = "media") -> DataFrame:
    """df without the binary column, with the FIELDS of its MPEG audio."""
    rest = [f for f in df.schema if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x.as_py() or b"") for x in batch[column]]
            rows = [
                {
                    "layer": a.runs[0][0].layer if a.runs else None, "hertz": a.runs[0][0].hertz if a.runs else None, "frames": len(a.offsets), "samples": a.samples, "duration_us": a.duration_us, "vbr_kind": a.vbr and a.vbr["kind"], "vbr_frames": a.vbr and a.vbr["frames"],
                    "crc_good": a.crc_good, "crc_bad": a.crc_bad, "resyncs": a.resyncs, "skipped": a.skipped, "tags": list(a.tags.items()), "frame_offsets": a.offsets.tolist(),
                }
                for a in found
            ]
            kinds = {"layer": pa.int32(), "hertz": pa.int32(), "vbr_kind": pa.string(), "tags": pa.map_(pa.string(), pa.string()), "frame_offsets": pa.list_(pa.int64())}
            names = [x.split()[0] for x in FIELDS.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in rest), *(pa.array([r[k] for r in rows], type=kinds.get(k, pa.int64())) for k in names)], names=[*(f.name for f in rest), *names])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), FIELDS]))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for x in batch["text"]:
            raw = b"" if not x.is_valid else x.as_buffer().to_pybytes()
            media = write(pad(raw))
            audio = parse(media)
            back = samples(media, audio)
            h = audio.runs[0][0]
            level = np.frombuffer(back, dtype=np.uint8)
            feature = f"mpeg{h.version}-layer{h.layer};hertz={h.hertz};kbits={h.kbits};frames={len(audio.offsets)};samples={audio.samples};duration_us={audio.duration_us};{audio.vbr['kind']}={audio.vbr['frames']};crc={audio.crc_good}/{audio.crc_good + audio.crc_bad};middle={audio.seek(audio.duration_us // 2)};last={audio.offsets[-1]};sum={int(level.sum())};peak={int(level.max())}"
            for own, v in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                own.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(v, type=k) for v, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def to_media(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, media: each text as a layer I file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([write(pad(b"" if not x.is_valid else x.as_buffer().to_pybytes())) for x in batch[text]], type=pa.binary())], names=["doc_id", "media"])

    return df.select("doc_id", text).mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, media binary")


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores each text, reads the stored bytes back and describes them: one task's memory holds one text's media."""
    docs = documents(table(spark, sf_dir, "documents"))
    return docs.mapInArrow(_describe, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
