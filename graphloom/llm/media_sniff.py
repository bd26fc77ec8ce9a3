"""Media columns: signature sniffing with an Aho-Corasick automaton and format validators.

One pass of the automaton over a blob finds all magic bytes. At each hit the format's validator reads the
structure from there (chunk lengths and checksums, segments, boxes, frame headers) and gives the length of the
file, or refuses. The valid file at offset 0 gives the blob's type; without one, text or unknown. Valid files
that start later, and inside no other valid file than the container at 0, are carved.

Result of ``sniffed``: one row for each blob and file found in it: id, part (0: the blob itself, 1 and on: carved
files by offset), declared, detected, corrected (detected differs from declared), offset, length, valid (the
structure covers the blob to its end, for part 0; true for carved files), sha256 of the bytes.

Defined cases: a null or empty blob has one row with detected null, length 0 and corrected false; where
no type was declared, the detected one counts as a correction; types are compared without parameters and by their usual aliases; truncated or
damaged files are refused, so such a blob is of unknown type (application/octet-stream); rows with one id are
separate blobs; all of a blob is searched, at any length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, table

TYPES = {"png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "wav": "audio/wav", "webp": "image/webp", "avi": "video/x-msvideo", "zip": "application/zip", "pdf": "application/pdf", "gzip": "application/gzip", "mp4": "video/mp4", "flac": "audio/flac", "ogg": "application/ogg", "mp3": "audio/mpeg", "mpeg": "audio/mpeg", "tiff": "image/tiff"}
ALIASES = {"image/jpg": "image/jpeg", "image/pjpeg": "image/jpeg", "audio/x-wav": "audio/wav", "audio/wave": "audio/wav", "image/x-ms-bmp": "image/bmp", "application/x-gzip": "application/gzip", "audio/mp3": "audio/mpeg", "image/x-png": "image/png"}
#: (magic bytes, format, offset of the magic bytes in the file)
MAGIC = [(b"\x89PNG\r\n\x1a\n", "png", 0), (b"GIF87a", "gif", 0), (b"GIF89a", "gif", 0), (b"\xff\xd8\xff", "jpeg", 0), (b"BM", "bmp", 0), (b"RIFF", "riff", 0), (b"PK\x03\x04", "zip", 0), (b"PK\x05\x06", "zip", 0), (b"%PDF-", "pdf", 0), (b"\x1f\x8b\x08", "gzip", 0), (b"ftyp", "mp4", 4), (b"fLaC", "flac", 0), (b"OggS", "ogg", 0), (b"ID3", "mp3", 0), (b"\xff\xfb", "mpeg", 0), (b"\xff\xfa", "mpeg", 0), (b"II*\x00", "tiff", 0), (b"MM\x00*", "tiff", 0)]


def png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack(">I4s", b[p : p + 8])
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or (first and n != 13):
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack(">I", b[p + 8 + n : p + 12 + n])[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    p, flags = at + 13, b[at + 10]
    p += 3 * (2 << (flags & 7)) if flags & 0x80 else 0

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1 if p < len(b) else 0

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21 and p + 2 < len(b):
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = blocks(p + 11 + (3 * (2 << (local & 7)) if local & 0x80 else 0))
        else:
            return 0
        if not p:
            return 0
    return 0


def jpeg(b: bytes, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        while p + 1 < len(b) and b[p + 1] == 0xFF:
            p += 1
        if p + 4 > len(b):  # the fill bytes led to the end
            break
        m = b[p + 1]
        if m == 0xD9:
            return p + 2 - at if frame else 0
        if m in (0x01, *range(0xD0, 0xD8)):
            p += 2
            continue
        n = struct.unpack(">H", b[p + 2 : p + 4])[0]
        if n < 2 or p + 2 + n > len(b) or m < 0xC0:
            return 0
        frame |= 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if m == 0xDA:  # coded data up to the next marker
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            if b[p + 1] == 0xD9:
                return p + 2 - at if frame else 0
    return p + 2 - at if frame and b[p : p + 2] == b"\xff\xd9" else 0


def bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    n, zero, data, head = struct.unpack("<IIII", b[at + 2 : at + 18])
    planes, bits = struct.unpack("<HH", b[at + 26 : at + 30])
    ok = zero == 0 and head in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + head <= data <= n
    return n if ok and at + n <= len(b) else 0


def riff(b: bytes, at: int) -> int:
    if at + 12 > len(b):
        return 0
    end = at + 8 + struct.unpack("<I", b[at + 4 : at + 8])[0]
    if end > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    p, some = at + 12, False
    while p + 8 <= end:
        n = struct.unpack("<I", b[p + 4 : p + 8])[0]
        p, some = p + 8 + n + (n & 1), True
    return end - at if some and p in (end, end + 1) else 0


def pkzip(b: bytes, at: int) -> int:
    p, local = at, 0
    while b[p : p + 4] == b"PK\x03\x04":
        if p + 30 > len(b):
            return 0
        flags, n, name, extra = struct.unpack("<H", b[p + 6 : p + 8])[0], *struct.unpack("<IIHH", b[p + 18 : p + 22] + b[p + 22 : p + 26] + b[p + 26 : p + 30])[:1], *struct.unpack("<HH", b[p + 26 : p + 30])
        p += 30 + name + extra + n
        local += 1
        if flags & 8:  # lengths follow the data: on to the next header
            q = [x for x in (b.find(b"PK\x03\x04", p), b.find(b"PK\x01\x02", p)) if x >= 0]
            if not q:
                return 0
            p = min(q)
    central, start = 0, p
    while b[p : p + 4] == b"PK\x01\x02" and p + 46 <= len(b):
        p += 46 + sum(struct.unpack("<HHH", b[p + 28 : p + 34]))
        central += 1
    if b[p : p + 4] != b"PK\x05\x06" or p + 22 > len(b) or central != local:
        return 0
    total, size, offset, note = struct.unpack("<HIIH", b[p + 10 : p + 22])
    ok = total == central and size == p - start and offset == start - at and p + 22 + note <= len(b)
    return p + 22 + note - at if ok else 0


def pdf(b: bytes, at: int) -> int:
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return 0
    stop = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, stop if stop > 0 else len(b))
    if end < 0 or b.find(b"startxref", at, end) < 0:
        return 0
    end += 5
    while b[end : end + 1] in (b"\r", b"\n"):
        end += 1
    return end - at


def gzip(b: bytes, at: int) -> int:
    d, p, view = zlib.decompressobj(31), at, memoryview(b)
    try:  # in pieces, so that a false hit costs no copy and a bomb no memory
        while p < len(b) and not d.eof:
            rest, p = view[p : p + 65_536], p + 65_536
            while len(rest) and not d.eof:
                d.decompress(rest, 1 << 20)
                rest = d.unconsumed_tail
    except zlib.error:
        return 0
    return min(p, len(b)) - at - len(d.unused_data) if d.eof else 0


def mp4(b: bytes, at: int) -> int:
    p, kinds = at, set()
    while p + 8 <= len(b):
        n, kind = struct.unpack(">I4s", b[p : p + 8])
        if n == 1 and p + 16 <= len(b):
            n = struct.unpack(">Q", b[p + 8 : p + 16])[0]
        if n < 8 or p + n > len(b) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"styp", b"uuid", b"meta", b"pdin", b"udta"):
            break
        kinds.add(kind)
        p += n
    return p - at if b"ftyp" in kinds and kinds & {b"moov", b"moof", b"mdat", b"meta"} else 0


def _crc_tables() -> tuple[list[int], list[int]]:
    """CRC-8 (polynomial 7) and CRC-16 (0x8005) by byte."""
    eight, sixteen = [], []
    for c in range(256):
        a, d = c, c << 8
        for _ in range(8):
            a = (a << 1 ^ (7 if a & 128 else 0)) & 255
            d = (d << 1 ^ (0x8005 if d & 0x8000 else 0)) & 0xFFFF
        eight.append(a)
        sixteen.append(d)
    return eight, sixteen


_CRC8, _CRC16 = _crc_tables()


def _flac_frame(b: bytes, p: int) -> int:
    """Samples of the frame whose header starts at p, 0 without a sound header."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8:
        return 0
    size, rate, lead = b[p + 2] >> 4, b[p + 2] & 15, b[p + 4]
    if not size or rate == 15 or b[p + 3] >> 4 > 10 or b[p + 3] & 1 or 0x80 <= lead < 0xC0 or lead == 0xFF:
        return 0
    q = p + 5 + (0 if lead < 0x80 else f"{lead:08b}".index("0") - 1)
    more = {6: 1, 7: 2}.get(size, 0)
    end = q + more + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(b):
        return 0
    c = 0
    for x in b[p:end]:
        c = _CRC8[c ^ x]
    if c != b[end]:
        return 0
    if more:
        return int.from_bytes(b[q : q + more], "big") + 1
    return 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)


def flac(b: bytes, at: int) -> int:
    """Metadata blocks, then frames, each with its header's CRC-8 and its CRC-16, up to STREAMINFO's samples.

    A frame ends where its CRC-16 comes out and the next frame's header follows; the last one, or each where the number of samples is not
    known, where it comes out first beyond the least size of a frame."""
    p, total, least = at + 4, 0, 0
    while p + 4 <= len(b):
        kind, n = b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")
        if (p == at + 4 and (kind, n) != (0, 34)) or kind == 127 or p + 4 + n > len(b):
            return 0
        if p == at + 4:
            least = int.from_bytes(b[p + 8 : p + 11], "big")
            total = int.from_bytes(b[p + 17 : p + 22], "big") & ((1 << 36) - 1)
        last, p = b[p] & 128, p + 4 + n
        if last:
            break
    else:
        return 0
    done = 0
    while (many := _flac_frame(b, p)) and (not total or done < total):
        done, crc, q, end = done + many, 0, p, 0
        low = p + max(least, 9)
        while q < len(b) and not end:
            crc = ((crc << 8) & 0xFF00) ^ _CRC16[(crc >> 8) ^ b[q]]
            q += 1
            if not crc and q >= low and (_flac_frame(b, q) or (done >= total)):
                end = q
        if not end:
            return 0
        p = end
    return p - at if done and done >= total else 0


def ogg(b: bytes, at: int, dead: set[int]) -> int:
    """Pages in a row. The pages of a row that broke off are noted, so that it isn't followed from each of them again."""
    p, seen = at, []
    while b[p : p + 5] == b"OggS\x00" and p + 27 <= len(b):
        n = b[p + 26]
        body = sum(b[p + 27 : p + 27 + n])
        if p in dead or p + 27 + n + body > len(b) or len(b) < p + 27 + n:
            dead.update(seen)
            return 0
        seen.append(p)
        p += 27 + n + body
    return p - at


LEAST_FRAMES = 4
_RATES = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]


def mp3(b: bytes, at: int) -> int:
    if at + 10 > len(b) or b[at + 3] > 4 or any(x & 128 for x in b[at + 6 : at + 10]):
        return 0
    p = at + 10 + sum((x & 127) << s for x, s in zip(b[at + 6 : at + 10], (21, 14, 7, 0)))
    end, frames = _frames(b, p)
    return end - at if frames else 0


def mpeg(b: bytes, at: int) -> int:
    """MPEG-1 layer III frames without a tag: LEAST_FRAMES at least, since a sync word alone is found in any data."""
    end, frames = _frames(b, at)
    return end - at if frames >= LEAST_FRAMES else 0


def _frames(b: bytes, p: int) -> tuple[int, int]:
    """(end, number) of the frames in a row from p on."""
    frames = 0
    while p + 4 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFE == 0xFA:
        rate, hz, pad = b[p + 2] >> 4, (b[p + 2] >> 2) & 3, (b[p + 2] >> 1) & 1
        if rate in (0, 15) or hz == 3:
            break
        n = 144_000 * _RATES[rate] // (44_100, 48_000, 32_000)[hz] + pad
        if p + n > len(b):
            break
        p, frames = p + n, frames + 1
    return p, frames


def tiff(b: bytes, at: int) -> int:
    e = "<" if b[at : at + 2] == b"II" else ">"
    if at + 8 > len(b):
        return 0
    end, p, seen = 8, struct.unpack(e + "I", b[at + 4 : at + 8])[0], set()
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    while p:
        if p in seen or p < 8 or at + p + 2 > len(b):
            return 0
        seen.add(p)
        n = struct.unpack(e + "H", b[at + p : at + p + 2])[0]
        if not n or at + p + 6 + 12 * n > len(b):
            return 0
        tags = {}
        for k in range(n):
            f = at + p + 2 + 12 * k
            tag, kind, count = struct.unpack(e + "HHI", b[f : f + 8])
            if kind not in sizes:
                return 0
            size = sizes[kind] * count
            where = f + 8 if size <= 4 else at + struct.unpack(e + "I", b[f + 8 : f + 12])[0]
            if where + size > len(b):
                return 0
            end = max(end, where + size - at if size > 4 else 0)
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                tags[tag] = struct.unpack(f"{e}{count}{'H' if kind == 3 else 'I'}", b[where : where + size])
        for o, s in ((273, 279), (324, 325)):
            for x, y in zip(tags.get(o, ()), tags.get(s, ())):
                end = max(end, x + y)
        end = max(end, p + 6 + 12 * n)
        p = struct.unpack(e + "I", b[at + p + 2 + 12 * n : at + p + 6 + 12 * n])[0]
    return end if at + end <= len(b) else 0


CHECKS = {"png": png, "gif": gif, "jpeg": jpeg, "bmp": bmp, "riff": riff, "zip": pkzip, "pdf": pdf, "gzip": gzip, "mp4": mp4, "flac": flac, "ogg": ogg, "mp3": mp3, "mpeg": mpeg, "tiff": tiff}
_RIFF = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}
_MACHINE = None


def machine():
    """The automaton over all magic bytes, once for each Python worker."""
    global _MACHINE
    if _MACHINE is None:
        import ahocorasick

        found = ahocorasick.Automaton()
        for magic, kind, back in MAGIC:
            found.add_word(magic.decode("latin-1"), (kind, back, len(magic)))
        found.make_automaton()
        _MACHINE = found
    return _MACHINE


def files(blob: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, format) of all valid files, outermost first, that lie in no other but one that starts at 0."""
    hits = sorted({(end + 1 - size - back, kind) for end, (kind, back, size) in machine().iter(blob.decode("latin-1"))})
    out, reach = [], 0
    dead: set[int] = set()
    for at, kind in hits:
        if at < 0 or (at < reach and at):
            continue
        try:
            n = CHECKS[kind](blob, at, dead) if kind == "ogg" else CHECKS[kind](blob, at)
        except (struct.error, IndexError):  # a header that the blob's end cuts off
            n = 0
        if n > 0:
            out.append((at, n, _RIFF[blob[at + 8 : at + 12]] if kind == "riff" else kind))
            reach = at + n if at else 0
    return out


def plain(blob: bytes) -> str:
    """Type of a blob without a known signature."""
    try:
        text = blob.decode("utf-8")
    except UnicodeDecodeError:
        return "application/octet-stream"
    if any(c < " " and c not in "\t\n\r\x0b\x0c" for c in text):
        return "application/octet-stream"
    head = text.lstrip("﻿ \t\r\n")[:512].lower()
    return "text/html" if head.startswith(("<!doctype html", "<html", "<head", "<body")) else "text/plain"


def _sniff(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for key, blob, declared in zip(batch.column("id").to_pylist(), batch.column("blob").to_pylist(), batch.column("declared").to_pylist()):
        said = None
        if declared is not None:
            said = declared.split(";")[0].strip().lower()
            said = ALIASES.get(said, said)
        if not blob:
            rows.append((key, 0, declared, None, False, 0, 0, False, None))
            continue
        found = files(blob)
        own = found[0] if found and found[0][0] == 0 else None
        kind = TYPES[own[2]] if own else plain(blob)
        rows.append((key, 0, declared, kind, said != kind, 0, len(blob), bool(own and own[1] == len(blob)) or kind.startswith("text/"), hashlib.sha256(blob).hexdigest()))
        inner = [f for f in found if f is not own]
        for part, (at, n, k) in enumerate(inner, 1):
            rows.append((key, part, declared, TYPES[k], False, at, n, True, hashlib.sha256(blob[at : at + n]).hexdigest()))
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    cols = list(zip(*rows)) or [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "part", "declared", "detected", "corrected", "offset", "length", "valid", "sha256"])


SCHEMA = "id long, part int, declared string, detected string, corrected boolean, offset long, length long, valid boolean, sha256 string"


def sniffed(media: DataFrame) -> DataFrame:
    """``media`` has the columns id, blob, declared."""
    rows = media.select(F.col("id").cast("long").alias("id"), F.col("blob").cast("binary").alias("blob"), F.col("declared").cast("string").alias("declared"))
    return arrow_map(rows, _sniff, SCHEMA)


def build(kind: str, text: bytes) -> bytes:
    """A small valid file of one of five formats that carries ``text``."""
    if kind == "png":
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", max(1, len(text)), 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + (text or b"\0"), 1)) + chunk(b"IEND", b"")
    if kind == "wav":
        body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(text)) + text + b"\0" * (len(text) & 1)
        return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body
    if kind == "gif":
        data = b"".join(bytes([len(p)]) + p for p in (text[i : i + 255] for i in range(0, len(text), 255)))
        return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x21\xfe" + data + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0\x3b"
    if kind == "gzip":
        c = zlib.compressobj(1, wbits=31)
        return c.compress(text) + c.flush()
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(text), 0, 54, 40, len(text), 1, 1, 8, 0, len(text), 0, 0, 0, 0) + text


KINDS = ["png", "wav", "gif", "gzip", "bmp"]


def _media_of_pages(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A media column from pages: by page_id, the page itself, a file that carries its bytes, or both in one blob;
    the declared type is right, wrong, or missing."""
    blobs, said = [], []
    for key, page in zip(batch.column("id").to_pylist(), batch.column("page").to_pylist()):
        key, raw = key or 0, (page or "").encode()
        kind = KINDS[key % 5]
        file = build(kind, raw)
        blobs.append([raw, file, raw + file + raw[:100], file + build(KINDS[(key + 1) % 5], raw[:500])][key // 5 % 4])
        said.append([TYPES[kind], "text/html; charset=utf-8", "image/jpeg", None][key // 20 % 4])
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(blobs, pa.binary()), pa.array(said, pa.string())], ["id", "blob", "declared"])


def op5_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), F.col("html").alias("page"))
    return sniffed(arrow_map(pages, _media_of_pages, "id long, blob binary, declared string"))


QUERIES = {"op5_media_sniff": op5_media_sniff}
SQL: dict[str, str] = {}
