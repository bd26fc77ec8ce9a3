import hashlib
import io
import random
import struct
import time
import zipfile

from graphloom.llm import media_sniff as ms

MEDIA = "id long, blob binary, declared string"
TEXT = b"some payload " * 20


def _closed(data, width, polynomial, size):
    """The data with its cyclic redundancy check, bit by bit."""
    crc = 0
    for c in data:
        for k in range(7, -1, -1):
            top = crc >> (width - 1) ^ (c >> k & 1)
            crc = (crc << 1 & ((1 << width) - 1)) ^ (polynomial if top else 0)
    return data + crc.to_bytes(size, "big")


def more():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello" * 30)
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xc0\x00\x0b\x08\0\1\0\1\1\1\x11\0\xff\xda\x00\x08\1\1\0\0?\0\x12\xff\x00\x34\xff\xd9"
    mp4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 12, b"mdat") + b"data"
    ogg = b"OggS\0\2" + bytes(20) + b"\x01\x05hello"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF\n"
    mp3 = b"ID3\x03\0\0\0\0\0\0" + (b"\xff\xfb\x90\x00" + bytes(413)) * 2
    tiff = b"II*\0" + struct.pack("<I", 12) + b"DATA" + struct.pack("<HHHIIHHIII", 2, 273, 4, 1, 8, 279, 4, 1, 4, 0)
    frame = lambda n: _closed(_closed(b"\xff\xf8\x19\x02" + bytes([n]), 8, 7, 1) + b"\0\x55", 16, 0x8005, 2)
    info = struct.pack(">HH", 192, 192) + bytes(6) + ((44_100 << 44) | (7 << 36) | 384).to_bytes(8, "big") + bytes(16)
    flac = b"fLaC\x80\0\0\x22" + info + frame(0) + frame(1)
    return {"zip": z.getvalue(), "jpeg": jpeg, "mp4": mp4, "ogg": ogg, "pdf": pdf, "mp3": mp3, "tiff": tiff, "flac": flac}


ALL = {k: ms.build(k, TEXT) for k in ms.KINDS} | more()


def test_each_format_and_its_length():
    for kind, b in ALL.items():
        assert ms.files(b) == [(0, len(b), kind)], kind
        assert ms.files(b"junk" + b + b"tail") == [(4, len(b), kind)], kind


def test_damage_is_refused():
    rnd = random.Random(0)
    for kind, b in ALL.items():
        for cut in {1, len(b) // 2, *(rnd.randrange(1, len(b)) for _ in range(5))}:
            for at, n, k in ms.files(b[:-cut]):
                assert at + n <= len(b) - cut and (kind in ("mp3", "ogg", "pdf", "mp4") or at > 0), (kind, cut, k)
    png = bytearray(ALL["png"])
    png[40] ^= 1
    assert ms.files(bytes(png)) == []


def _check(kind, blob, at):
    try:
        return ms.CHECKS[kind](blob, at, set()) if kind == "ogg" else ms.CHECKS[kind](blob, at)
    except (struct.error, IndexError):
        return 0


def test_carving_equals_brute_force():
    """Every offset tried with every validator, without the automaton."""
    rnd = random.Random(1)
    for _ in range(60):
        blob = b"".join(rnd.choice([rnd.choice(list(ALL.values())), rnd.randbytes(rnd.randint(0, 40))]) for _ in range(6))
        want, reach = [], 0
        for at in range(len(blob)):
            for magic, kind, back in ms.MAGIC:
                if blob.startswith(magic, at + back) and at >= reach and (n := _check(kind, blob, at)):
                    want.append((at, n, ms._RIFF[blob[at + 8 : at + 12]] if kind == "riff" else kind))
                    reach = at + n if at else 0
        assert ms.files(blob) == want


def test_rows(spark):
    png, gif = ALL["png"], ALL["gif"]
    rows = [(1, png, "image/png"), (2, png, "image/gif"), (3, b"<html>" + gif, "text/html; x"), (4, png + gif, None), (5, None, "image/png"), (6, b"", None), (7, b"\xff\x00", "x"), (None, b"plain", "text/plain"), (1, png, "IMAGE/X-PNG")]
    got = [tuple(r) for r in ms.sniffed(spark.createDataFrame([(*r, 1) for r in rows], MEDIA + ", part int")).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == [
        (1, 0, "image/png", "image/png", False, 0, len(png), True, sha(png)),
        (2, 0, "image/gif", "image/png", True, 0, len(png), True, sha(png)),
        (3, 0, "text/html; x", "application/octet-stream", True, 0, 6 + len(gif), False, sha(b"<html>" + gif)),
        (3, 1, "text/html; x", "image/gif", False, 6, len(gif), True, sha(gif)),
        (4, 0, None, "image/png", True, 0, len(png + gif), False, sha(png + gif)),
        (4, 1, None, "image/gif", False, len(png), len(gif), True, sha(gif)),
        (5, 0, "image/png", None, False, 0, 0, False, None),
        (6, 0, None, None, False, 0, 0, False, None),
        (7, 0, "x", "application/octet-stream", True, 0, 2, False, sha(b"\xff\x00")),
        (None, 0, "text/plain", "text/plain", False, 0, 5, True, sha(b"plain")),
        (1, 0, "IMAGE/X-PNG", "image/png", False, 0, len(png), True, sha(png)),
    ]
    assert ms.sniffed(spark.createDataFrame([], MEDIA)).count() == 0


def test_fuzz_never_fails():
    """Magic bytes, pieces of files and random bytes, cut anywhere."""
    rnd = random.Random(5)
    pieces = [m for m, _, _ in ms.MAGIC] + [b[: rnd.randint(4, 60)] for b in ALL.values()] + [b"\xff", b"\xff\xd8\xff\xff\xff\xff", b"\0\0\0\x10", b"PK\x01\x02"]
    for _ in range(100_000):
        blob = b"".join(rnd.choice(pieces) if rnd.random() < 0.6 else rnd.randbytes(rnd.randint(0, 12)) for _ in range(rnd.randint(1, 5)))
        for at, n, _ in ms.files(blob[: rnd.randint(1, len(blob))] if blob else b""):
            assert at >= 0 and n > 0


def test_time_is_in_proportion_to_length():
    for piece in (b"\x1f\x8b\x08", b"OggS\0" + bytes(21) + b"\x01\x05hello", b"\xff\xd8\xff\xe0\0\x04ab", b"%PDF-1.4 ", b"\xff\xfb\x90\0", b"ID3\x03\0\0\0\0\0\0"):
        took = []
        for n in (4_000, 16_000):
            began = time.process_time()
            ms.files(piece * n + b"O")
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 0.2, (piece, took)


def test_tagless_mpeg_and_bombs():
    frames = (b"\xff\xfb\x90\x00" + bytes(413)) * 5
    assert ms.files(b"x" + frames + b"y") == [(1, len(frames), "mpeg")]
    assert ms.files(b"\xff\xfb\x90\x00" + bytes(413)) == []
    bomb = ms.build("gzip", bytes(50_000_000))
    assert ms.files(bomb + b"tail") == [(0, len(bomb), "gzip")]
