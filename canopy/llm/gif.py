"""GIF media columns: encode samples losslessly, decode any GIF into timed frames with histograms.

The decoder reads LZW code streams (the width of a code depends only on how many codes came since
the last clear code, so codes are cut out of the bit streams in numpy, many streams at once), applies global and local
palettes, interlacing, transparency and the disposal rules, and gives the canvas after each frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm._util import as_bytes, groups_of, prepare

#: Pixels in a row and rows in a frame of media that pack_samples() writes.
WIDTH, ROWS = 192, 16
#: Bytes of samples or media that are coded or decoded together.
GROUP = 1 << 22
#: Colours in a histogram: two bits for each channel.
BINS = 64


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, for a minimum code size."""
    entries = (1 << size) + 2 + np.maximum(np.arange(n, dtype=np.int64) - 1, 0)  # known when the code is read
    return np.minimum(np.maximum(np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1, size + 1), 12)


_table: dict[int, np.ndarray] = {}


def _bits_before(size: int) -> np.ndarray:
    """Bits that the first n codes after a clear code take, for n from 0."""
    if size not in _table:
        _table[size] = np.concatenate([[0], np.cumsum(_widths(5000, size))])
    return _table[size]


#: Samples that a stream codes between two clear codes; less than the table can name.
SPAN = 3072
#: Bits of the hash table that each stream has while it is coded; SPAN entries fill it by 3/4 at most.
_SLOTS = 12
_BIT = np.arange(12, dtype=np.uint16)


def lzw_encode_many(streams: list[bytes]) -> list[bytes]:
    """LZW with a minimum code size of 8 of many streams, which advance in step.

    Every SPAN samples of a stream are a run of their own after a clear code. All runs take one
    sample per step: a hash table for each run maps (code, sample) to the longer code.
    """
    runs, owner = [], []
    for i, data in enumerate(streams):
        for at in range(0, max(1, len(data)), SPAN):
            runs.append(data[at : at + SPAN])
            owner.append(i)
    codes, count = _run_codes(runs)
    last = np.append(np.diff(np.array(owner)) != 0, True)
    # each run is: clear, its codes, and for a stream's last run the end code
    total = count + 1 + last
    first = np.cumsum(total) - total
    every = np.empty(int(total.sum()), np.uint16)
    every[first] = 256
    at = np.repeat(first + 1 - (np.cumsum(count) - count), count) + np.arange(len(codes))
    every[at] = codes
    every[(first + total - 1)[last]] = 257
    nth = np.arange(len(every)) - np.repeat(first, total)  # 0 is the clear code
    widths = np.diff(_bits_before(8))[np.maximum(nth - 1, 0)]
    start = np.append(True, last[:-1])
    previous = np.where(start, 9, np.diff(_bits_before(8))[np.roll(count, 1)])
    widths[first] = previous  # a clear code is as wide as the code that it cuts off would be
    ends = np.cumsum(widths)
    closing = np.flatnonzero(last)
    stop = ends[(first + total - 1)[closing]]
    bits = ((every[:, None] >> _BIT) & np.uint16(1)).astype(np.uint8)[_BIT < widths[:, None]]
    begin = np.concatenate([[0], stop[:-1]])
    return [np.packbits(bits[x:y], bitorder="little").tobytes() for x, y in zip(begin.tolist(), stop.tolist())]


def _run_codes(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all runs, one after another, and how many each has."""
    size = np.fromiter(map(len, runs), np.int64, len(runs))
    order = np.argsort(-size, kind="stable")
    steps, n = int(size.max(initial=0)), len(runs)
    if not steps:
        return np.zeros(0, np.uint16), np.zeros(n, np.int64)
    grid = np.zeros((n, steps), np.uint8)
    for row, i in enumerate(order.tolist()):
        grid[row, : size[i]] = np.frombuffer(runs[i], np.uint8)
    grid = np.ascontiguousarray(grid.T).astype(np.int32)
    active = np.searchsorted(-size[order], -np.arange(steps), side="left")  # runs longer than the step
    out = np.full((steps + 1, n), -1, np.int16)
    entries = np.full(n << _SLOTS, -1, np.int32)  # (code, sample) << 12 | longer code
    base = np.arange(n, dtype=np.int64) << _SLOTS
    fresh = np.full(n, 258, np.int32)
    current = grid[0].copy()
    mask = (1 << _SLOTS) - 1
    for t in range(1, steps):
        a = int(active[t])
        if a < n and a < int(active[t - 1]):
            ended = slice(a, int(active[t - 1]))
            out[t, ended] = current[ended]
        sample = grid[t, :a]
        key = current[:a] << 8 | sample
        slot = base[:a] + ((key * 40503 >> 4) & mask)
        held = entries[slot]
        off = np.flatnonzero((held >= 0) & (held >> 12 != key))
        while len(off):  # try the next slot
            moved = slot[off]
            moved = (moved & ~mask) | ((moved + 1) & mask)
            slot[off] = moved
            there = entries[moved]
            held[off] = there
            off = off[(there >= 0) & (there >> 12 != key[off])]
        miss = np.flatnonzero(held < 0)
        out[t, miss] = current[miss]
        entries[slot[miss]] = key[miss] << 12 | fresh[miss]
        fresh[miss] += 1
        current[:a] = held & 0xFFF
        current[miss] = sample[miss]
    a = int(active[steps - 1])
    out[steps, :a] = current[:a]
    if steps == 1:
        out[1, :a] = current[:a]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    flat = out.T[back]
    some = flat >= 0
    return flat[some].astype(np.uint16), some.sum(axis=1)


def lzw_encode(data: bytes) -> bytes:
    return lzw_encode_many([data])[0]


def lzw_decode_many(streams: list[tuple[bytes, int, int]]) -> list[bytes]:
    """Samples of many LZW streams, each given as (bytes, minimum code size, samples wanted)."""
    out = [bytearray() for _ in streams]
    if not streams:
        return []
    for size in {x[1] for x in streams}:
        if not 1 <= size <= 11:
            raise ValueError("a code size that GIF lacks")
        some = [i for i, x in enumerate(streams) if x[1] == size]
        _decode_some(some, streams, size, out)
    return [bytes(x[: s[2]]) for x, s in zip(out, streams)]


def _decode_some(some: list[int], streams: list[tuple[bytes, int, int]], size: int, out: list[bytearray]) -> None:
    clear, end = 1 << size, (1 << size) + 1
    blob = b"".join(streams[i][0] for i in some)
    raw = np.frombuffer(blob + bytes(8), np.uint8).astype(np.uint32)
    word = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    stop = np.cumsum([8 * len(streams[i][0]) for i in some])  # bits
    at = np.concatenate([[0], stop[:-1]])
    live = np.arange(len(some))
    before = _bits_before(size)
    first_width = np.uint32((1 << (size + 1)) - 1)
    while len(live):
        while True:  # a run of clear codes says no more than one
            ok = at[live] + size + 1 <= stop[live]
            live = live[ok]
            code = (word[at[live] >> 3] >> (at[live] & 7).astype(np.uint32)) & first_width
            leads = live[code == clear]
            if not len(leads):
                break
            at[leads] += size + 1
        if not len(live):
            return
        room = stop[live] - at[live]
        fit = np.searchsorted(before, room, side="right") - 1
        over = room > before[-1]
        fit = np.where(over, len(before) - 1 + (room - before[-1]) // 12, fit)
        first = np.cumsum(fit) - fit
        nth = np.arange(int(fit.sum())) - np.repeat(first, fit)
        deep = np.maximum(nth - (len(before) - 1), 0)
        place = np.repeat(at[live], fit) + before[nth - deep] + 12 * deep
        width = np.where(deep > 0, 12, np.diff(before, append=before[-1] + 12)[nth - deep]).astype(np.uint32)
        codes = ((word[place >> 3] >> (place & 7).astype(np.uint32)) & ((np.uint32(1) << width) - np.uint32(1))).astype(np.int64)
        marks = np.flatnonzero((codes == clear) | (codes == end))
        hit = np.searchsorted(marks, first)
        mark = np.append(marks, len(codes))[hit]
        used = np.minimum(mark - first, fit)
        keep = nth < np.repeat(used, fit)
        parts = _expand(codes[keep], used, clear)
        for i, part in zip(live.tolist(), parts):
            out[some[i]] += part
        more = (mark < first + fit) & (codes[np.minimum(mark, len(codes) - 1)] == clear)
        at[live[more]] = (place + width)[mark[more]]
        wanted = np.array([streams[some[i]][2] > len(out[some[i]]) for i in live.tolist()], bool)
        live = live[more & wanted]


def _expand(codes: np.ndarray, count: np.ndarray, clear: int) -> list[bytes]:
    """What runs of codes, each since a clear code, stand for; count: codes in each run.

    Entry clear + 2 + j is what code j gave and the byte after it, so it is a slice of the output
    itself: each output byte is a literal or a copy of an earlier one, and pointers to earlier
    bytes are followed by doubling, for all bytes of all runs at once.
    """
    order = np.arange(len(codes))
    base = np.repeat(np.cumsum(count) - count, count)
    copied = codes > clear
    source = np.where(copied, codes - (clear + 2) + base, order)
    if (source[copied] >= order[copied]).any() or (codes == clear + 1).any():
        raise ValueError("an LZW code that its table lacks")
    steps, size = source, copied.astype(np.int64)
    while copied[steps].any():  # length: one byte more than the code it copies
        size = size + size[steps]
        steps = steps[steps]
    size += 1
    after = np.cumsum(size)
    begin = after - size
    at = np.arange(int(size.sum())) - np.repeat(begin - begin[source], size)
    literal = np.zeros(len(at), np.uint8)
    literal[begin[~copied]] = codes[~copied]
    while True:
        then = at[at]
        if np.array_equal(then, at):
            break
        at = then
    data = literal[at].tobytes()
    upto = np.append(0, after)[np.cumsum(count)].tolist()
    return [data[x:y] for x, y in zip([0, *upto], upto)]


def lzw_decode(data: bytes, size: int, limit: int) -> bytes:
    """Samples of an LZW stream with the given minimum code size, up to limit of them."""
    return lzw_decode_many([(data, size, limit)])[0]


def gif(frames: list[np.ndarray], coded: list[bytes] | None = None, delay: int = 10, palette: np.ndarray | None = None) -> bytes:
    """A GIF of 8-bit index frames (rows by columns), each drawn at the top left; delay in 1/100 s.

    coded: the frames' LZW streams, if they are at hand.
    """
    colours = np.repeat(np.arange(256, dtype=np.uint8), 3) if palette is None else palette.astype(np.uint8).ravel()
    height, width = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), colours.tobytes()]
    for f, data in zip(frames, coded or lzw_encode_many([f.tobytes() for f in frames])):
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))  # disposal 1: leave
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0) + b"\x08")
        for i in range(0, len(data), 255):
            block = data[i : i + 255]
            parts.append(bytes([len(block)]) + block)
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    index: int
    delay_ms: int
    disposal: int
    box: tuple[int, int, int, int]  # left, top, width, height
    canvas: np.ndarray  # height, width, RGBA: what is shown during this frame


@dataclass
class _Image:
    box: tuple[int, int, int, int]
    colours: np.ndarray
    interlaced: bool
    stream: tuple[bytes, int, int]
    disposal: int
    delay: int
    through: int  # the transparent index, or -1


def _parse(data: bytes) -> tuple[int, int, list[_Image]]:
    """Width, height and images of a GIF. Raises ValueError for what is no GIF or breaks off."""
    try:
        return _parsed(data)
    except (struct.error, IndexError) as e:
        raise ValueError("the GIF breaks off") from e


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise IndexError
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _parsed(data: bytes) -> tuple[int, int, list[_Image]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common, images = 13, None, []
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    disposal, delay, through = 0, 0, -1
    while data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            if label == 0xF9 and data[at] >= 4:
                packed, delay, index = struct.unpack_from("<BHB", data, at + 1)
                disposal, through = packed >> 2 & 7, index if packed & 1 else -1
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = common
        if packed & 0x80:
            colours, at = _palette(data, at, packed)
        if colours is None:
            raise ValueError("a frame without a palette")
        size = data[at]
        at += 1
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
        at += 1
        images.append(_Image((left, top, w, h), colours, bool(packed & 0x40), (b"".join(parts), size, w * h), disposal, delay, through))
        disposal, delay, through = 0, 0, -1
    return width, height, images


def _compose(width: int, height: int, images: list[_Image], samples: list[bytes]) -> Iterator[Frame]:
    canvas = np.zeros((height, width, 4), np.uint8)
    for index, (image, data) in enumerate(zip(images, samples)):
        left, top, w, h = image.box
        if len(data) < w * h:  # a stream that ends early leaves the rest as it was, or of index 0
            data += bytes([max(image.through, 0)]) * (w * h - len(data))
        rows = np.frombuffer(data, np.uint8).reshape(h, w)
        if image.interlaced:  # rows come in four passes
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(rows)
            straight[order] = rows
            rows = straight
        before = canvas.copy() if image.disposal == 3 else None
        w, h = max(0, min(w, width - left)), max(0, min(h, height - top))
        rows = rows[:h, :w]
        area = canvas[top : top + h, left : left + w]
        table = np.zeros((256, 4), np.uint8)
        table[: len(image.colours), :3], table[:, 3] = image.colours, 255
        if image.through >= 0:
            seen = rows != image.through
            area[seen] = table[rows[seen]]
        else:
            area[:] = table[rows]
        yield Frame(index, 10 * image.delay, image.disposal, (left, top, w, h), canvas.copy())
        if image.disposal == 2:
            area[:] = 0
        elif image.disposal == 3:
            canvas = before


def decode(data: bytes) -> Iterator[Frame]:
    """The shown frames of a GIF. Raises ValueError for what is no GIF or breaks off."""
    width, height, images = _parse(data)
    yield from _compose(width, height, images, lzw_decode_many([x.stream for x in images]))


def decode_many(media: list[bytes]) -> Iterator[list[Frame]]:
    """decode() of many GIFs, whose code streams are decoded together."""
    parsed = [_parse(x) for x in media]
    samples = iter(lzw_decode_many([x.stream for _, _, images in parsed for x in images]))
    for width, height, images in parsed:
        yield list(_compose(width, height, images, [next(samples) for _ in images]))


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels by colour, two bits of each channel."""
    v = np.ascontiguousarray(pixels).reshape(-1).view("<u4")
    code = (v >> 2 & 0x30) | (v >> 12 & 0xC) | (v >> 22 & 3)
    shown = v >= 1 << 24
    return np.bincount(code if shown.all() else code[shown], minlength=BINS)


def pack_samples(payloads: list[bytes]) -> list[bytes]:
    """For each payload a GIF whose frames hold it row by row as indexes of a grey palette."""
    frames = []
    for x in payloads:
        rows = np.frombuffer(x, np.uint8).reshape(-1, WIDTH)
        frames.append([rows[i : i + ROWS] for i in range(0, len(rows), ROWS)])
    coded = lzw_encode_many([f.tobytes() for each in frames for f in each])
    out, at = [], 0
    for each in frames:
        out.append(gif(each, coded[at : at + len(each)]))
        at += len(each)
    return out


def unpack_samples(media: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """Payload of each GIF that pack_samples() made, its colour histogram and number of frames."""
    for frames in decode_many(media):
        parts, counts = [], np.zeros(BINS, np.int64)
        for frame in frames:
            left, top, w, h = frame.box
            shown = frame.canvas[top : top + h, left : left + w]
            parts.append(shown[:, :, 0].tobytes())
            counts += histogram(shown)
        yield b"".join(parts), counts, len(frames)


def decode_frames(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per frame: id, frame, delay_ms, start_ms, disposal, width, height, rgba, histogram, error.

    A null or broken GIF gives one row with its error and the other columns null.
    """
    prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("frame", pa.int32()), ("delay_ms", pa.int32()), ("start_ms", pa.int64()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
        for batch in batches:
            for i, data in enumerate(batch["media"].to_pylist()):
                rows, start = [], 0
                try:
                    for f in decode(data or b""):
                        rows.append((f.index, f.delay_ms, start, f.disposal, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), histogram(f.canvas).tolist(), None))
                        start += f.delay_ms
                except ValueError as e:
                    rows.append((None,) * 8 + (str(e),))
                if rows:
                    at = batch["id"].take(pa.array([i] * len(rows)))
                    yield pa.RecordBatch.from_arrays([at, *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types))], ["id", *schema.names])

    given = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, frame int, delay_ms int, start_ms bigint, disposal int, width int, height int, rgba binary, histogram array<bigint>, error string").withColumnRenamed("id", id_col)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each whole text (null: empty), padded with spaces to rows of 192 samples, as a GIF."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch["text"])
            padded = [x + b" " * (max(WIDTH, -(-len(x) // WIDTH) * WIDTH) - len(x)) for x in texts]
            media = [m for a, b in groups_of(padded, GROUP) for m in pack_samples(padded[a:b])]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, frames.

    Everything but n_bytes is computed from the stored media, which is decoded. feature: the shares
    of the non-empty colour bins, in thousandths, as bin:share. Equal texts have equal values; a
    null text counts as empty (one row of 192 spaces). An empty table gives no rows.
    """
    prepare(media.sparkSession)
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names[2:]]
            held = batch["media"].to_pylist()
            for data, (payload, counts, n) in zip(held, (x for a, b in groups_of(held, GROUP) for x in unpack_samples(held[a:b]))):
                share = counts * 1000 // max(1, int(counts.sum()))
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), ",".join(f"{i}:{share[i]}" for i in np.flatnonzero(counts)), n)
                for c, x in zip(cols, row):
                    c.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n_bytes"], *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    given = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, frames int").withColumnRenamed("id", id_col)
