"""Parsers of byte formats: bit reader, start codes, images, WAV, marker scans, tar indexes, numbered files, guide pages.

Each is a plain function over bytes; `parse_files` runs one over files in Arrow batches, a generator of rows per file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BitReader:
    """Reads bits most significant first, finds byte-aligned marks, and can return to a place."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0  # at: bits from the start

    def bits(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise EOFError
        lo, hi = self.at // 8, (self.at + n + 7) // 8
        v = int.from_bytes(self.data[lo:hi], "big") >> (8 * hi - self.at - n)
        self.at += n
        return v & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        at, v = self.at, self.bits(n)
        self.at = at
        return v

    def seek(self, mark: bytes, limit: int) -> bool:
        """To the next byte-aligned mark within limit bytes; leaves the place as it is if there is none."""
        start = (self.at + 7) // 8
        found = self.data.find(mark, start, start + limit + len(mark))
        if found >= 0:
            self.at = 8 * found
        return found >= 0


# Last bytes of start codes.
PICTURE, SEQUENCE, SEQUENCE_END, GROUP = 0x00, 0xB3, 0xB7, 0xB8
KINDS = {1: "I", 2: "P", 3: "B", 4: "D"}


def video_units(data: bytes) -> Iterator[tuple[int, int, int, str, int, bool, bool]]:
    """(unit, start, length, kind, temporal reference, has sequence header, ends the sequence) of each picture. Headers
    before a picture are part of its unit."""
    marks, at = [], data.find(b"\0\0\1")
    while 0 <= at and at + 3 < len(data):
        marks.append((at, data[at + 3]))
        at = data.find(b"\0\0\1", at + 3)
    unit, start, seq, picture = 0, None, False, None
    for at, code in marks:
        if picture is not None and code in (PICTURE, SEQUENCE, GROUP, SEQUENCE_END):
            end = at + 4 if code == SEQUENCE_END else at
            yield unit, start, end - start, *picture, seq, code == SEQUENCE_END
            unit, start, seq, picture = unit + 1, None, False, None
        if code in (PICTURE, SEQUENCE, GROUP) and start is None:
            start = at
        if code == SEQUENCE:
            seq = True
        if code == PICTURE and at + 6 <= len(data):
            bits = BitReader(data[at + 4 : at + 8])
            ref = bits.bits(10)
            picture = (KINDS.get(bits.bits(3), "?"), ref)
    if picture is not None:
        yield unit, start, len(data) - start, *picture, seq, False


# Kilobits a second by index, for (version, layer); versions at lower rates share those of 2.
AUDIO_RATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
# Samples a second of version 1; how often they are halved by version bits.
SAMPLE_RATES = [44100, 48000, 32000]
HALVED = {3: 0, 2: 1, 0: 2}


def audio_units(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(unit, start, length, samples a second) of MPEG audio frames of all versions and layers; bytes that begin no
    frame are passed over, a last frame may be short."""
    at, unit = 0, 0
    while at + 4 <= len(data):
        a, b, c = data[at : at + 3]
        version, layer, index, freq = b >> 3 & 3, 4 - (b >> 1 & 3), c >> 4, c >> 2 & 3
        if a == 0xFF and b >= 0xE0 and version in HALVED and layer < 4 and 0 < index < 15 and freq < 3:
            rate = SAMPLE_RATES[freq] >> HALVED[version]
            slots, size = (12, 4) if layer == 1 else (144, 1)
            n = size * (AUDIO_RATES[1 if version == 3 else 2, layer][index] * slots * 1000 // rate + (c >> 1 & 1))
            yield unit, at, min(n, len(data) - at), rate
            unit, at = unit + 1, at + n
        else:
            at += 1


# Kilobits a second by half the size code, and samples a second.
AC3_RATES = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]
AC3_SAMPLE_RATES = [48000, 44100, 32000]


def ac3_units(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(unit, start, length, samples a second) of AC-3 frames: 1536 samples in whole 16-bit words, one more at 44.1 kHz
    under an odd size code. An incomplete last frame goes; other bytes between frames are an error."""
    at, unit = 0, 0
    while at + 5 <= len(data):
        freq, code = data[at + 4] >> 6, data[at + 4] & 63
        if data[at : at + 2] != b"\x0b\x77" or freq == 3 or code >= 2 * len(AC3_RATES):
            raise ValueError(f"no AC-3 frame at byte {at}")
        rate = AC3_SAMPLE_RATES[freq]
        n = 2 * (AC3_RATES[code // 2] * 96000 // rate + (code % 2 if rate == 44100 else 0))
        if at + n <= len(data):
            yield unit, at, n, rate
        unit, at = unit + 1, at + n


def dts_units(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(unit, start, length, samples) of DTS frames. An incomplete last frame goes; other bytes between frames are an
    error."""
    at, unit = 0, 0
    while at + 8 <= len(data):
        if data[at : at + 4] != b"\x7f\xfe\x80\x01":
            raise ValueError(f"no DTS frame at byte {at}")
        bits = BitReader(data[at + 4 : at + 8])
        bits.bits(7)
        samples, n = 32 * (bits.bits(7) + 1), bits.bits(14) + 1
        if at + n <= len(data):
            yield unit, at, n, samples
        unit, at = unit + 1, at + n


def scan_payloads(df: DataFrame, key: str, payload: str, scanner: Callable[[bytes], Iterator[tuple]], fields: list[str]) -> DataFrame:
    """The rows of a scanner over each binary payload: key, then its fields as longs. Null holds none. No shuffle."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            keys, columns = [], [[] for _ in fields]
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in scanner(data or b""):
                    keys.append(k)
                    for c, v in zip(columns, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *[pa.array(c, pa.int64()) for c in columns]], names=[key, *fields])

    return df.select(key, payload).mapInArrow(run, ", ".join([f"{key} {kind}", *[f"{f} long" for f in fields]]))


def fixed_units(size: int, frame: int) -> Iterator[tuple[int, int, int]]:
    """(unit, start, length) of uncompressed audio: frames of one size, the last may be short."""
    for unit, at in enumerate(range(0, size, frame)):
        yield unit, at, min(frame, size - at)


def sniff(data: Column) -> Column:
    """What a byte prefix begins, by the first rule that fits."""
    h = F.hex(F.substring(data, 1, 4))
    return F.when(h.startswith("000001B3"), "video").when(h.startswith("000001BA"), "system").when(h.startswith("0B77"), "ac3").when(h.startswith("7FFE8001"), "dts").when(h.rlike("^FFF[C-F]"), "mpeg audio").when(h.startswith("52494646"), "riff").when(h.startswith("FFD8FF"), "jpeg").otherwise("unknown")


def markers(data: bytes) -> list[tuple[int, int, int]]:
    """(marker, offset, length) of a JPEG's segments, up to and with the scan."""
    out, at = [], 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        m = data[at + 1]
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        out.append((m, at, n))
        if m == 0xDA:
            break
        at += 2 + n
    return out


def wav_header(data: bytes) -> dict:
    """Channels, rate, bits and the place of the samples of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV")
    at, out = 12, {}
    while at + 8 <= len(data):
        name, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
            out |= {"kind": kind, "channels": channels, "rate": rate, "bits": bits}
        elif name == b"data":
            return out | {"offset": at + 8, "length": n}
        at += 8 + n + n % 2
    raise ValueError("no samples")


def netpbm(data: bytes) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """(frame, width, height, channels, samples) of concatenated P5, P6 and P7 images."""
    at, frame = 0, 0
    while at < len(data):
        if data[at : at + 1].isspace():
            at += 1
            continue
        kind = data[at : at + 2]
        if kind == b"P7":
            end = data.index(b"ENDHDR\n", at) + 7
            head = dict(x.split(None, 1) for x in data[at + 3 : end - 8].decode().splitlines() if x and not x.startswith("#"))
            w, h, c, at = int(head["WIDTH"]), int(head["HEIGHT"]), int(head["DEPTH"]), end
        elif kind in (b"P5", b"P6"):
            at, nums = at + 2, []
            while len(nums) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                stop = at
                while data[stop : stop + 1].isdigit():
                    stop += 1
                if stop == at:
                    raise ValueError("broken image header")
                nums.append(int(data[at:stop]))
                at = stop
            (w, h, _), c, at = nums, 3 if kind == b"P6" else 1, at + 1
        else:
            raise ValueError("no image")
        n = w * h * c
        if at + n > len(data):
            raise ValueError("an image is cut short")
        yield frame, w, h, c, list(data[at : at + n])
        frame, at = frame + 1, at + n


def to_netpbm(w: int, h: int, channels: int, samples: list[int]) -> bytes:
    return f"P{6 if channels == 3 else 5}\n{w} {h}\n255\n".encode() + bytes(samples)


def tar_index(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(name, offset of the content, size) of a tar's entries."""
    at = 0
    while at + 512 <= len(data) and data[at]:
        name = data[at : at + 100].split(b"\0")[0].decode()
        size = int(data[at + 124 : at + 136].strip(b" \0") or b"0", 8)
        yield name, at + 512, size
        at += 512 + -(-size // 512) * 512


def frame_number(name: Column) -> Column:
    """The number at the end of a file name, before its extension."""
    return F.regexp_extract(name, r"(\d+)(?:\.\w+)?$", 1).try_cast("long")


def number_range(df: DataFrame, name: str, *by: str) -> DataFrame:
    """First and last frame number of numbered files."""
    n = frame_number(F.col(name))
    return df.groupBy(*by).agg(F.min(n).alias("first_frame"), F.max(n).alias("last_frame"), F.count(n).alias("n"))


class GuidePage(HTMLParser):
    """Rows of a page: each link's target and text, under the heading that stands before it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.heading, self.href, self.text, self.inside = [], None, None, "", False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href, self.text = dict(attrs).get("href"), ""
        elif tag in ("h1", "h2", "h3", "title"):
            self.inside, self.heading = True, ""

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.rows.append((self.heading, self.href, self.text.strip()))
            self.href = None
        elif tag in ("h1", "h2", "h3", "title"):
            self.inside = False

    def handle_data(self, data):
        if self.href is not None:
            self.text += data
        elif self.inside:
            self.heading = (self.heading or "") + data


def guide_rows(html: str | None) -> list[tuple]:
    page = GuidePage()
    page.feed(html or "")
    page.close()
    return page.rows


def listings(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, row, heading, target, title of every page."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            rows = [(k, i, *r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, r in enumerate(guide_rows(t))]
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], b.schema.field(0).type), pa.array(c[1], pa.int64()), *[pa.array(x, pa.string()) for x in c[2:]]], names=[key, "row", "heading", "target", "title"])

    return df.select(key, html).mapInArrow(run, f"{key} {kind}, row long, heading string, target string, title string")


def parse_files(spark: SparkSession, path: str, parser: Callable[[bytes], Iterator[tuple]], schema: str, at_once: int = 10_000) -> DataFrame:
    """Runs a parser over each file's bytes: path and the parser's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType.fromDDL("path string, " + schema)
    arrow = to_arrow_schema(whole)

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for r in parser(content):
                    rows.append((p, *r))
                    if len(rows) == at_once:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, whole)
