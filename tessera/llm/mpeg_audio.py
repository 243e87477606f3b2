"""Operator 3: MPEG audio as a media column.

``read_audio`` parses any MPEG-1, 2 or 2.5 audio bytes of Layers I to III: it skips and reads ID3v2 and ID3v1 tags (with the
extended header's CRC-32), resynchronises on frame headers (one is believed if the next follows where it says, or the
data ends there), reads Xing, Info and VBRI tables, verifies the frames' CRC-16, and gives exact durations and the byte
offset of every frame for seeking. ``store_payload`` writes bytes losslessly as a variable-bitrate MPEG-1 Layer III
stream: silent frames whose main data is ancillary, so that the format's unit is the ancillary byte.

Defined cases: null media or text counts as empty; empty bytes have no frame and duration 0; bytes before, between and after frames
are counted as skipped; free-format frames aren't recognised; Layer II checksums are counted as unchecked (they cover
side information that depends on allocation tables); a repeated doc_id gives a row each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Memo, arrow_map, documents, written

UNIT, RATE = 192, 48_000

# fixed values: bitrates in kbit/s by index 1 to 14, of MPEG-1 Layers I, II, III and of MPEG-2 Layers I, II and III alike
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# fixed values: sample rates by version bits and index
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
        table.append(crc & 0xFFFF)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ byte]
    return crc


def header(word: bytes) -> tuple | None:
    """length, samples, rate, layer, version, channels, has CRC, length of the side information that the CRC covers."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    index, rate_index, pad = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    first = version == 3
    kbps, rate, mono = BITRATES[1 if first else 2, layer][index - 1], RATES[version][rate_index], word[3] >> 6 == 3
    if layer == 1:
        length, samples, side = (12_000 * kbps // rate + pad) * 4, 384, 16 if mono else 32
    else:
        samples = 1152 if first or layer == 2 else 576
        length, side = samples // 8 * 1000 * kbps // rate + pad, (17 if mono else 32) if first else (9 if mono else 17)
    if layer == 1 and word[3] >> 6 == 1:  # joint stereo: the bound says how many bands have an allocation each
        bound = 4 * ((word[3] >> 4 & 3) + 1)
        side = (2 * bound + 32 - bound) // 2
    return length, samples, rate, layer, {3: 1.0, 2: 2.0, 0: 2.5}[version], 1 if mono else 2, not word[1] & 1, side


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3v2(data: bytes) -> tuple[int, dict[str, str], bool | None]:
    """Size of a leading tag, its text frames, and whether its CRC-32 holds (None: it has none)."""
    if len(data) < 10 or data[:3] != b"ID3" or data[3] not in (3, 4):
        return 0, {}, None
    end = min(10 + _syncsafe(data[6:10]), len(data))
    at, crc, tags = 10, None, {}
    if data[5] & 0x40 and data[3] == 3 and end >= 24:
        size, flags = struct.unpack(">IH", data[10:16])
        at = 14 + size
        if flags & 0x8000 and size >= 10:
            pad, want = struct.unpack(">II", data[16:24])
            crc = zlib.crc32(data[at : max(end - pad, at)]) == want
    while at + 10 <= end and data[at : at + 4].isalnum():
        size = struct.unpack(">I", data[at + 4 : at + 8])[0] if data[3] == 3 else _syncsafe(data[at + 4 : at + 8])
        body = data[at + 10 : min(at + 10 + size, end)]
        name = data[at : at + 4].decode("ascii")
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            name, text = ("TXXX:" + text.partition("\0")[0], text.partition("\0")[2]) if name == "TXXX" else (name, text)
            tags[name] = text
        at += 10 + size
    return end, tags, crc


def bitrate_table(frame: bytes, head: tuple) -> dict | None:
    """A Xing, Info or VBRI table of a first frame: kind, frames, bytes, the seek table (bytes at equal steps of time, as far as the
    header tells them) and the encoder's delay and padding in samples."""
    at = 4 + (2 if head[6] else 0) + head[7]
    for at in (at, 4 + head[7]):
        if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            kind, flags = frame[at : at + 4].decode(), struct.unpack(">I", frame[at + 4 : at + 8])[0]
            at, out = at + 8, {"kind": kind, "frames": None, "bytes": None, "toc": [], "delay": 0, "padding": 0}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit and len(frame) >= at + 4:
                    out[name] = struct.unpack(">I", frame[at : at + 4])[0]
                    at += 4
            if flags & 4 and len(frame) >= at + 100:
                out["toc"] = [p * (out["bytes"] or 0) // 256 for p in frame[at : at + 100]]
                at += 100
            at += 4 if flags & 8 else 0
            if frame[at : at + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= at + 24:
                both = int.from_bytes(frame[at + 21 : at + 24], "big")
                out |= {"delay": both >> 12, "padding": both & 0xFFF}
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        delay, _, size, frames, n, scale, width, _ = struct.unpack(">HHIIHHHH", frame[42:62])
        entries = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(n)] if width and 62 + n * width <= len(frame) else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": [sum(entries[:k]) for k in range(len(entries))], "delay": delay, "padding": 0}
    return None


def parser() -> Callable[[bytes], dict]:
    """A function that parses MPEG audio bytes; it remembers the headers and checksums it has met."""
    heads, sums = Memo(header, 5_000), Memo(crc16, 50_000)

    def parse(data: bytes) -> dict:
        start, tags, tag_crc = id3v2(data)
        end = len(data)
        if end - start >= 128 and data[-128:-125] == b"TAG":
            end -= 128
            tags |= {f"v1:{k}": data[end + a : end + a + 30].rstrip(b"\0 ").decode("latin-1") for k, a in (("title", 3), ("artist", 33), ("album", 63))}
        out = {"tags": tags, "tag_crc": tag_crc, "table": None, "crc_good": 0, "crc_bad": 0, "crc_unchecked": 0, "skipped": 0, "resyncs": 0, "truncated": False}
        offsets, bodies, samples, rate, first = [], [], 0, 0, None
        at, lost = start, False
        while at + 4 <= end:
            head = heads[data[at : at + 4]]
            if head and (not offsets or lost):  # believe a first header, or one after a loss, only if the next one follows
                after = at + head[0]
                if after + 4 <= end and (heads[data[after : after + 4]] or (0,) * 5)[2:5] != head[2:5] or after > end:
                    head = None
            if not head:
                found = data.find(b"\xff", at + 1, end)
                found = end if found < 0 else found
                out["skipped"] += found - at
                out["resyncs"] += bool(offsets) and not lost
                at, lost = found, True
                continue
            lost = False
            if at + head[0] > end:
                out["truncated"] = True
                break
            side = 4 + (2 if head[6] else 0) + head[7]
            if first is None:
                first = head
                out["table"] = bitrate_table(data[at : at + head[0]], head)
            if head[6]:
                if head[3] == 2:
                    out["crc_unchecked"] += 1
                else:
                    good = sums[data[at + 2 : at + 4] + data[at + 6 : at + side]] == data[at + 4] << 8 | data[at + 5]
                    out["crc_good" if good else "crc_bad"] += 1
            if offsets or not out["table"]:
                samples += head[1]
            offsets.append(at)
            bodies.append((at + side, at + head[0]))
            rate = head[2]
            at += head[0]
        out["skipped"] += max(end - at, 0)
        if out["table"]:  # what the encoder put before and after the sound doesn't count
            samples = max(samples - out["table"]["delay"] - out["table"]["padding"], 0)
        return out | {"first": first, "offsets": offsets, "bodies": bodies, "samples": samples, "rate": rate}

    return parse


def frame(kbps: int, body: bytes, checksum: bool = True) -> bytes:
    """A silent MPEG-1 Layer III mono frame at 48 kHz with ``body`` as its ancillary data."""
    head = bytes((0xFF, 0xFA if checksum else 0xFB, BITRATES[1, 3].index(kbps) + 1 << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    check = struct.pack(">H", crc16(head[2:] + side)) if checksum else b""
    return (head + check + side + body).ljust(3 * kbps, b"\0")


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\0" + text.encode("latin-1")
    return name + struct.pack(">IH", len(body), 0) + body


def writer() -> Callable[[bytes, int], bytes]:
    """A function that stores a payload, and the number of its bytes that are content, as an MPEG audio stream."""
    starts = {k: frame(k, b"")[:23] for k in BITRATES[1, 3]}
    most = BITRATES[1, 3][-1]

    def write(payload: bytes, content: int) -> bytes:
        room, frames = 3 * most - 23, []
        for at in range(0, len(payload), room):
            part = payload[at : at + room]
            kbps = next(k for k in BITRATES[1, 3] if 3 * k - 23 >= len(part))
            frames.append((starts[kbps] + part).ljust(3 * kbps, b"\0"))
        size = sum(map(len, frames)) + 192
        ends = np.cumsum([192] + [len(f) for f in frames])
        toc = bytes(min(255, int(ends[int(len(frames) * p / 100)]) * 256 // size) for p in range(100))
        info = frame(64, b"Xing" + struct.pack(">III", 7, len(frames), size) + toc, checksum=False)
        text = _text_frame(b"TLEN", str(len(frames) * 24)) + _text_frame(b"TXXX", f"payload\0{len(payload)}") + _text_frame(b"TXXX", f"content\0{content}")
        tag = struct.pack(">IHII", 10, 0x8000, 0, zlib.crc32(text)) + text
        n = len(tag)
        return b"ID3\3\0\x40" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + tag + info + b"".join(frames)

    return write


def payload_of(data: bytes, parsed: dict) -> bytes:
    """The stored payload: the ancillary bytes of the frames after the table."""
    return b"".join([data[a:b] for a, b in parsed["bodies"][1:]])[: int(parsed["tags"].get("TXXX:payload", 0))]


def feature(parsed: dict) -> str:
    first, table, n = parsed["first"], parsed["table"] or {}, len(parsed["offsets"])
    if not first:
        return "none"
    seconds = parsed["samples"] / parsed["rate"]
    seek = zlib.crc32(np.array(parsed["offsets"], "<u8").tobytes())
    return (
        f"mpeg{first[4]:g} layer{first[3]} {first[2]}Hz {first[5]}ch frames={n} samples={parsed['samples']} seconds={seconds:.6f} "
        f"crc={parsed['crc_good']}/{parsed['crc_good'] + parsed['crc_bad']} tag={parsed['tag_crc']} table={table.get('kind')}:{table.get('frames')} "
        f"skipped={parsed['skipped']} resyncs={parsed['resyncs']} seek={seek:08x}"
    )


def store_payload(docs: DataFrame) -> DataFrame:
    """doc_id and media: the whole text of every row, padded with blanks to a positive multiple of ``UNIT``, as MPEG audio."""

    def make():
        write = writer()

        def step(doc_id, text):
            media = []
            for t in text:
                raw = (t or "").encode()
                media.append(write(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "), len(raw)))
            return {"doc_id": pa.array(doc_id, pa.int64()), "media": pa.array(media, pa.binary())}

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, media binary", 500)


def read_audio(media: DataFrame) -> DataFrame:
    """doc_id, duration in samples and seconds, frame offsets, checks and tags of every row (doc_id, media)."""

    def make():
        parse = parser()

        def step(doc_id, media):
            got = [parse(m or b"") for m in media]
            return {
                "doc_id": pa.array(doc_id, pa.int64()),
                "n_frames": pa.array([len(g["offsets"]) for g in got], pa.int64()),
                "samples": pa.array([g["samples"] for g in got], pa.int64()),
                "seconds": pa.array([g["samples"] / g["rate"] if g["rate"] else 0.0 for g in got], pa.float64()),
                "crc_good": pa.array([g["crc_good"] for g in got], pa.int64()),
                "crc_bad": pa.array([g["crc_bad"] for g in got], pa.int64()),
                "skipped": pa.array([g["skipped"] for g in got], pa.int64()),
                "resyncs": pa.array([g["resyncs"] for g in got], pa.int64()),
                "tags": pa.array([list(g["tags"].items()) for g in got], pa.map_(pa.string(), pa.string())),
                "frame_offsets": pa.array([g["offsets"] for g in got], pa.list_(pa.int64())),
                "seek_table": pa.array([(g["table"] or {}).get("toc", []) for g in got], pa.list_(pa.int64())),
            }

        return step

    return arrow_map(media.select("doc_id", "media"), make, "doc_id long, n_frames long, samples long, seconds double, crc_good long, crc_bad long, skipped long, resyncs long, tags map<string,string>, frame_offsets array<long>, seek_table array<long>", 500)


def digests(media: DataFrame) -> DataFrame:
    """The stored payloads read back, and their features."""

    def make():
        parse = parser()

        def step(doc_id, media):
            media = [m or b"" for m in media]
            got = [parse(m) for m in media]
            back = [payload_of(m, g) for m, g in zip(media, got)]
            return {
                "doc_id": pa.array(doc_id, pa.int64()),
                "n_bytes": pa.array([int(n) if (n := g["tags"].get("TXXX:content", "")).isdecimal() else None for g in got], pa.int64()),
                "payload_bytes": pa.array([len(b) for b in back], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()),
                "media_bytes": pa.array([len(m) for m in media], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                "feature": pa.array([feature(g) for g in got], pa.string()),
                "seconds": pa.array([g["samples"] / g["rate"] if g["rate"] else 0.0 for g in got], pa.float64()),
                "frame_offsets": pa.array([g["offsets"] for g in got], pa.list_(pa.int64())),
            }

        return step

    return arrow_map(media, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, frame_offsets array<long>", 500)


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(written(store_payload(documents(spark, sf_dir)), "audio"))
