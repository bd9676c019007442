"""Lossless WebP: a decoder of the whole format, and an encoder for payloads.

The decoder reads prefix codes, back-references and the colour cache, and inverts the predictor, cross-colour, subtract-green and
palette transforms; it returns a pixel array (height, width, 4) of alpha, red, green, blue. Where an image has one group of codes,
numpy looks up at every bit what a token beginning there would be and where the next one would begin; the tokens are then found by
following these jumps, and pixels, back-references and cache are made of them in order.

The encoder writes samples as red, green, blue or, if it reckons this shorter, each as a grey pixel. Colours: it takes what it reckons
shortest of no transform, subtract-green, cross-colour, prediction from the left or from above, and a palette; repeated colours go
by the cache. Grey: subtract-green leaves one channel, as it is or predicted, and few greys become a palette; a cache cannot shorten
one channel. Equal stretches become back-references, and each image has prefix codes of its own.

encode_all and decode_greys do many images at once and store and read the same bytes: numpy takes their samples, tokens and bits one
after the other, so that its calls are shared. Images other than grey ones, and large ones, go one by one.
"""

from __future__ import annotations

import functools
import struct
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np

#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
SIGNATURE = 0x2F
WIDTH, GREY_WIDTH, MOST_ROWS = 64, 192, 16384


@functools.cache
def near_distances() -> list[tuple[int, int]]:
    """The pixels nearby that the 120 short distance codes stand for, in order of distance, then of |x|, right before left."""
    around = [(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0]
    return sorted(around, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


@functools.cache
def _near_array() -> np.ndarray:
    return np.array(near_distances())


class Bits:
    """Bits of a byte string, the low ones first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        self.held |= int.from_bytes(part.ljust(8, b"\0"), "little") << self.n
        self.at += 8
        self.n += 64

    def more(self) -> None:
        if self.at > len(self.data) + 16:
            raise ValueError("the stream ends too early")
        self.fill()

    def read(self, n: int) -> int:
        if self.n < n:
            self.more()
        value = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return value

    def place(self) -> int:
        """Bits read so far."""
        return self.at * 8 - self.n

    def seek(self, place: int) -> None:
        self.at, self.held, self.n = place // 8, 0, 0
        self.read(place % 8)


@functools.cache
def _backwards() -> np.ndarray:
    """Each 15-bit number with its bits in reverse."""
    n = np.arange(1 << 15)
    return sum((n >> k & 1) << (14 - k) for k in range(15))


@functools.cache
def _backwards_list() -> list[int]:
    return _backwards().tolist()


class Code:
    """A canonical prefix code."""

    def __init__(self, lengths: list[int]) -> None:
        used = [s for s, n in enumerate(lengths) if n]
        self.one = used[0] if len(used) == 1 else (None if used else 0)
        self.lengths = {lengths[s] for s in used}
        self.symbols = sorted(used, key=lambda s: (lengths[s], s))
        self.first: dict[int, tuple[int, int, int]] = {}  # by length: the first code, how many, and where in symbols they begin
        code = at = 0
        last = 0
        counts = Counter(lengths)
        for n in sorted(self.lengths):
            code <<= n - last
            k = counts[n]
            self.first[n] = (code, k, at)
            code, at, last = code + k, at + k, n
        if self.one is None and code != 1 << last:
            raise ValueError("the prefix code is not complete")

    def table(self) -> tuple[int, np.ndarray, np.ndarray]:
        """By the next bits: how many they are, and for each value of them the symbol and the length of its code."""
        if self.one is not None:
            return 0, np.array([self.one], np.int32), np.zeros(1, np.int32)
        wide = max(self.lengths)
        back = _backwards()[: 1 << wide] >> (15 - wide)
        sizes = np.repeat(np.array(list(self.first), np.int32), [k for _, k, _ in self.first.values()])
        times = 1 << (wide - sizes)  # by codes in order, then by their bits in reverse
        return (1 << wide) - 1, np.array(self.symbols, np.int32).repeat(times)[back], sizes.repeat(times)[back]

    def read(self, bits: Bits) -> int:
        if self.one is not None:
            return self.one
        code = n = 0
        while n < 15:
            code = code << 1 | bits.read(1)
            n += 1
            if (found := self.first.get(n)) and 0 <= code - found[0] < found[1]:
                return self.symbols[found[2] + code - found[0]]
        raise ValueError("no such code")


@functools.cache
def _single(alphabet: int, symbol: int) -> Code:
    """The code of one symbol."""
    lengths = [0] * alphabet
    lengths[symbol] = 1
    return Code(lengths)


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbol = bits.read(8 if wide else 1)
        if not two:
            return _single(alphabet, symbol)
        lengths[symbol] = lengths[bits.read(8)] = 1
        return Code(lengths)
    of_lengths = [0] * 19
    for k in range(4 + bits.read(4)):
        of_lengths[CODE_LENGTH_ORDER[k]] = bits.read(3)
    mask, symbols, sizes = (x if isinstance(x, int) else x.tolist() for x in Code(of_lengths).table())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        if bits.n < 16:
            bits.more()
        ahead = bits.held
        symbol, n = symbols[ahead & mask], sizes[ahead & mask]
        if symbol < 16:
            lengths[at] = symbol
            before = symbol or before
            at += 1
        else:
            ahead >>= n
            value, times, k = (before, 3 + (ahead & 3), 2) if symbol == 16 else (0, 3 + (ahead & 7), 3) if symbol == 17 else (0, 11 + (ahead & 127), 7)
            n += k
            if at + times > alphabet:
                raise ValueError("code lengths beyond the alphabet")
            if value:
                lengths[at : at + times] = [value] * times
            at += times
        bits.held >>= n
        bits.n -= n
    return Code(lengths)


def _value(bits: Bits, prefix: int) -> int:
    """Of a length or distance prefix with its extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as 32-bit ARGB in rows."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    blocks, block_bits, n_groups = None, 0, 1
    if main and bits.read(1):
        block_bits = bits.read(3) + 2
        across = -(-width >> block_bits)
        blocks = (read_image(bits, across, -(-height >> block_bits), False) >> 8) & 0xFFFF
        n_groups = int(blocks.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(n_groups)]
    total = width * height
    if n_groups == 1 and total >= QUICK:
        return _read_quick(bits, groups[0], total, width, cache_bits).reshape(height, width)
    pixels = [0] * total
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    green, red, blue, alpha, distance = groups[0]
    at = 0
    while at < total:
        if blocks is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, distance = groups[blocks[y >> block_bits, x >> block_bits]]
        symbol = green.read(bits)
        begin = at
        if symbol < 256:
            r, b = red.read(bits), blue.read(bits)
            pixels[at] = alpha.read(bits) << 24 | r << 16 | symbol << 8 | b
            at += 1
        elif symbol < 280:
            length = _value(bits, symbol - 256)
            far = _value(bits, distance.read(bits))
            if far > 120:
                far -= 120
            else:
                x, y = near_distances()[far - 1]
                far = max(1, x + y * width)
            if far > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + length):  # it may overlap what it writes
                pixels[k] = pixels[k - far]
            at += length
        else:
            pixels[at] = cache[symbol - 280]
            at += 1
        if cache_bits:
            for k in range(begin, at):
                cache[(HASH * pixels[k] & 0xFFFFFFFF) >> shift] = pixels[k]
    return np.array(pixels, np.uint32).reshape(height, width)


#: Smaller images are read token by token.
QUICK = 32
#: Bytes looked up at once, and bits that no token exceeds.
CHUNK, TOKEN = 1 << 12, 192


def _values(prefix: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of length or distance prefixes the values, and how many of the bits ahead they take."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + (ahead & ((1 << extra) - 1))) + 1, extra


def _read_quick(bits: Bits, group: list[Code], total: int, width: int, cache_bits: int) -> np.ndarray:
    """Pixels of an image of one group."""
    tables = [c.table() for c in group]
    data, place, near = np.frombuffer(bits.data, np.uint8), bits.place(), near_distances()
    pixels, done = np.zeros(total, np.uint32), 0
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits

    def remember(start: int, end: int) -> None:
        """Puts pixels into the cache in their order."""
        for v in pixels[start:end].tolist():
            cache[(HASH * v & 0xFFFFFFFF) >> shift] = v

    while done < total:
        begin = place >> 3
        part = np.zeros(min(CHUNK, max(0, len(data) - begin)) + TOKEN // 4, np.uint8)
        have = data[begin : begin + len(part)]
        part[: len(have)] = have
        four = part.astype(np.uint32)
        four = four[:-3] | four[1:-2] << 8 | four[2:-1] << 16 | four[3:] << 24
        ahead = (four[:, None] >> np.arange(8, dtype=np.uint32)).ravel().view(np.int32)  # what lies ahead of each bit, 25 bits at least

        def look(k: int, at: np.ndarray, ahead: np.ndarray = ahead) -> tuple[np.ndarray, np.ndarray]:
            mask, symbol, length = tables[k]
            if not mask:
                return symbol, at
            key = ahead.take(at) & mask
            return symbol.take(key), at + length.take(key)

        every = np.arange(len(ahead) - TOKEN, dtype=np.int32)
        first, after = look(0, every)
        first = np.broadcast_to(first, every.shape)
        red, jump = look(1, after)
        blue, jump = look(2, jump)
        alpha, jump = look(3, jump)
        grows, far = None, None
        copies = np.flatnonzero((first >= 256) & (first < 280) if cache_bits else first >= 256)
        if len(copies) or cache_bits:
            grows, far, jump = np.ones(len(every), np.int32), np.zeros(len(every), np.int32), jump.copy()
            if cache_bits:
                jump = np.where(first >= 280, after, jump)
            grows[copies], extra = _values(first[copies] - 256, ahead[after[copies]])
            prefix, at = look(4, after[copies] + extra)
            far[copies], extra = _values(np.broadcast_to(prefix, at.shape), ahead[at])
            jump[copies] = at + extra
        at, left, end = place & 7, total - done, len(every)
        # Eight jumps at once; places beyond the end stay where they are.
        one = np.arange(end + TOKEN, dtype=np.int32)
        one[:end] = jump
        two = one.take(one)
        four_on = two.take(two)
        seen, to = [], memoryview(four_on.take(four_on))
        follow = seen.append
        for _ in range(-(-left // 8)):  # every token makes a pixel at least
            follow(at)
            at = to[at]
            if at >= end:
                break
        tokens = np.empty((len(seen), 8), np.int64)
        tokens[:, 0] = seen
        tokens[:, 4] = four_on.take(tokens[:, 0])
        tokens[:, 2::4] = two.take(tokens[:, ::4])
        tokens[:, 1::2] = one.take(tokens[:, ::2])
        tokens = tokens.ravel()[:left]
        tokens = tokens[: int(np.searchsorted(tokens, end))]
        at = int(one[tokens[-1]]) if len(tokens) else at
        sizes = grows[tokens] if grows is not None else np.ones(len(tokens), np.int32)
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1] > left:  # followed beyond the image
            tokens = tokens[: int(np.searchsorted(ends, left)) + 1]
            sizes, ends = sizes[: len(tokens)], ends[: len(tokens)]
            at = int(one[tokens[-1]])
        if not len(tokens) or (begin << 3) + at > len(data) * 8:
            raise ValueError("the stream ends too early")
        place = (begin << 3) + at
        kind, starts = first[tokens], ends - sizes + done
        if done + int(ends[-1]) > total:
            raise ValueError("a back-reference leaves the image")
        pick = lambda a, tokens=tokens: a[tokens] if len(a) > 1 else a
        pixels[starts] = pick(alpha).astype(np.uint32) << 24 | pick(red).astype(np.uint32) << 16 | (kind & 0xFF).astype(np.uint32) << 8 | pick(blue).astype(np.uint32)
        said = done
        odd = np.flatnonzero(kind >= 256)
        for symbol, begun, length, back in zip(kind[odd].tolist(), starts[odd].tolist(), sizes[odd].tolist(), far[tokens[odd]].tolist() if len(odd) else (), strict=True):
            if cache_bits:
                remember(said, begun)
                said = begun
            if symbol >= 280:
                pixels[begun] = cache[symbol - 280]
                continue
            if back > 120:
                back -= 120
            else:
                x, y = near[back - 1]
                back = max(1, x + y * width)
            if back > begun:
                raise ValueError("a back-reference leaves the image")
            if back >= length:
                pixels[begun : begun + length] = pixels[begun - back : begun - back + length]
            else:  # it overlaps what it writes
                pixels[begun : begun + length] = np.resize(pixels[begun - back : begun], length)
        done += int(ends[-1])
        if cache_bits:
            remember(said, done)
    bits.seek(place)
    return pixels


def _split(argb: np.ndarray) -> np.ndarray:
    """Channels alpha, red, green, blue on a last axis."""
    return np.stack([argb >> s & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _blown(blocks: np.ndarray, size_bits: int, height: int, width: int) -> np.ndarray:
    return blocks.repeat(1 << size_bits, 0).repeat(1 << size_bits, 1)[:height, :width]


def undo_cross_colour(px: np.ndarray, blocks: np.ndarray, size_bits: int) -> np.ndarray:
    t = _split(_blown(blocks, size_bits, *px.shape[:2]))
    signed = lambda a: a - ((a & 0x80) << 1)
    delta = lambda a, b: signed(a) * signed(b) >> 5
    out = px.copy()
    out[..., 1] = px[..., 1] + delta(t[..., 3], px[..., 2]) & 0xFF
    out[..., 3] = px[..., 3] + delta(t[..., 2], px[..., 2]) + delta(t[..., 1], out[..., 1]) & 0xFF
    return out


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    """Red and blue, held apart in one number, get green each."""
    return argb & np.uint32(0xFF00FF00) | (argb & np.uint32(0x00FF00FF)) + (argb >> np.uint32(8) & np.uint32(0xFF)) * np.uint32(0x00010001) & np.uint32(0x00FF00FF)


def undo_palette(argb: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    n = len(colours)
    per_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    index = argb >> 8 & 0xFF
    if per_bits:
        size, x = 8 >> per_bits, np.arange(width)
        index = index[:, x >> per_bits] >> ((x & ((1 << per_bits) - 1)) * size).astype(np.uint32) & ((1 << size) - 1)
    table = np.zeros(256, np.uint32)
    table[:n] = colours
    return table[index]


def _predict(mode: int, left, top, top_left, top_right):
    mean = lambda a, b: (a + b) >> 1
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        return left if abs(top - top_left).sum() < abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        m = mean(left, top)
        d = m - top_left
        return np.clip(m + (abs(d) // 2) * np.sign(d), 0, 255)
    return np.array([255, 0, 0, 0], np.int32)


def undo_predictor(px: np.ndarray, blocks: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = px.shape[:2]
    modes = blocks >> 8 & 0xF
    out = np.zeros_like(px)
    out[0, 0] = px[0, 0] + [255, 0, 0, 0] & 0xFF
    out[0, 1:] = np.cumsum(np.concatenate([out[0, :1], px[0, 1:]]), 0)[1:] & 0xFF  # the first row is predicted from the left
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = px[y, 0] + above[0] & 0xFF
        line = modes[y >> size_bits]
        for block in range(len(line)):
            mode = int(line[block])
            a, b = max(1, block << size_bits), min(width, (block + 1) << size_bits)
            if a >= b:
                continue
            if mode in (2, 4, 8) or mode == 0 or mode > 13:  # of the row above alone: the whole block at once
                t, tl = above[a:b], above[a - 1 : b - 1]
                row[a:b] = px[y, a:b] + _predict(mode, None, t, tl, None) & 0xFF
            elif mode == 1:
                row[a:b] = np.cumsum(np.concatenate([row[a - 1 : a], px[y, a:b]]), 0)[1:] & 0xFF
            else:
                for x in range(a, b):  # right of the last column lies the first of this row
                    corner = above[x + 1] if x + 1 < width else row[0]
                    row[x] = px[y, x] + _predict(mode, row[x - 1], above[x], above[x - 1], corner) & 0xFF
    return out


def _chunk(data: bytes) -> bytes:
    """The lossless image of a file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, 8 + struct.unpack("<I", data[4:8])[0]
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"VP8L":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no lossless image")


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) as alpha, red, green, blue."""
    return decode_vp8l(_chunk(data))


def _read_head(bits: Bits) -> tuple[int, int, int, list[Callable[[np.ndarray], np.ndarray]]]:
    """Width as coded, height, whether there is alpha, and what undoes the transforms, the first one first."""
    if bits.read(8) != SIGNATURE:
        raise ValueError("no signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, coded, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is given twice")
        seen.add(kind)
        if kind == 2:
            undo.append(undo_subtract_green)
        elif kind == 3:
            n = bits.read(8) + 1
            colours = _join(np.cumsum(_split(read_image(bits, n, 1, False)), 1) & 0xFF)[0]
            undo.append(lambda argb, c=colours, w=coded: undo_palette(argb, c, w))
            per = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            coded = -(-coded >> per)
        else:
            size = bits.read(3) + 2
            blocks = read_image(bits, -(-coded >> size), -(-height >> size), False)
            inverse = undo_cross_colour if kind else undo_predictor
            undo.append(lambda argb, f=inverse, b=blocks, s=size: _join(f(_split(argb), b, s)))
    return coded, height, has_alpha, undo


def decode_vp8l(data: bytes) -> np.ndarray:
    bits = Bits(data)
    coded, height, has_alpha, undo = _read_head(bits)
    argb = read_image(bits, coded, height, True)
    for f in reversed(undo):
        argb = f(argb)
    out = np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)[..., ::-1].copy()
    if not has_alpha:
        out[..., 0] = 255
    return out


def _join(px: np.ndarray) -> np.ndarray:
    p = px.astype(np.uint32)
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


# Writing


class BitsOut:
    def __init__(self) -> None:
        self.value, self.n = 0, 0
        self.done: list[bytes] = []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Many at once, in parts, so that memory is bounded."""
        for at in range(0, len(values), 1 << 15):
            v, n = values[at : at + (1 << 15)], sizes[at : at + (1 << 15)]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            starts = ends - n
            # Words of 32 bits; a value of up to 32 lies in one or two, and sums of bits apart from one another are exact.
            word, v = starts >> 5, v << (starts & 31)
            words = np.bincount(word, v & 0xFFFFFFFF, (total >> 5) + 2)
            words[1:] += np.bincount(word, v >> 32, len(words) - 1)
            self.flush(words.astype("<u4").tobytes()[: -(-total // 8)], total)

    def flush(self, data: bytes, n: int) -> None:
        self.value |= int.from_bytes(data, "little") << self.n
        self.n += n
        whole = self.n // 8
        self.done.append((self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
        self.value >>= 8 * whole
        self.n -= 8 * whole

    def bytes(self) -> bytes:
        return b"".join(self.done) + self.value.to_bytes(-(-self.n // 8), "little")


def put_one(out: BitsOut, symbol: int) -> None:
    """A code of one symbol, which takes no bits."""
    out.put(0b101 if symbol > 1 else 0b001, 3)
    out.put(symbol, 8 if symbol > 1 else 1)


@functools.cache
def _run(value: int, run: int) -> list[tuple[int, int, int]]:
    """Symbols, extra bits and how many, for so many equal lengths."""
    tokens = []
    if value:
        tokens.append((value, 0, 0))
        run -= 1
    while run >= 3:
        most, symbol, least, n = (6, 16, 3, 2) if value else (138, 18, 11, 7) if run >= 11 else (10, 17, 3, 3)
        tokens.append((symbol, min(run, most) - least, n))
        run -= min(run, most)
    return tokens + [(value, 0, 0)] * run


@functools.lru_cache(1 << 12)
def _code_of_lengths(used: frozenset[int]) -> tuple[int, int, dict[int, int], dict[int, int]]:
    """The code for these symbols of lengths: how it is written, in how many bits, and each symbol's code and its length."""
    # Codes of one width; of more than 16 symbols the last ones are a bit longer.
    width = min(4, max(1, (len(used) - 1).bit_length()))
    spare = (s for s in range(19) if s not in used)
    coded = sorted([*used, *(next(spare) for _ in range((1 << width) - len(used)))])
    longer = max(0, 2 * len(used) - 32)
    size = {s: width + (i >= len(coded) - longer) for i, s in enumerate(coded)}
    value, n = 15 << 1, 5
    for s in CODE_LENGTH_ORDER:
        value |= size.get(s, 0) << n
        n += 3
    code, at, last, backwards = {}, 0, width, _backwards_list()
    for s in sorted(coded, key=lambda s: (size[s], s)):
        at <<= size[s] - last
        last = size[s]
        code[s] = backwards[at] >> (15 - last)
        at += 1
    return value, n + 1, code, size


def put_lengths(out: BitsOut, lengths: list[int]) -> None:
    """A code by its lengths, runs of zeros and repeats shortened."""
    tokens: list[tuple[int, int, int]] = []
    at = 0
    for symbol in [s for s, n in enumerate(lengths) if n]:
        if symbol < at:
            continue
        if symbol > at:
            tokens += _run(0, symbol - at)
        value, at = lengths[symbol], symbol + 1
        while at < len(lengths) and lengths[at] == value:
            at += 1
        tokens += _run(value, at - symbol)
    if at < len(lengths):
        tokens += _run(0, len(lengths) - at)
    value, n, code, size = _code_of_lengths(frozenset([t[0] for t in tokens]))
    for symbol, extra, k in tokens:
        wide = size[symbol]
        value |= (code[symbol] | extra << wide) << n
        n += wide + k
    out.put(value, n)


def put_code(out: BitsOut, code: int, n: int) -> None:
    """The highest bit first."""
    out.put(int(f"{code:0{n}b}"[::-1], 2) if n else 0, n)


def container(stream: bytes) -> bytes:
    body = b"WEBP" + b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def code_lengths(counts: list[int]) -> list[int]:
    """Lengths of a best prefix code of at most 15 bits; counts flatten until it has none longer."""
    while True:
        leaves = sorted((n, s) for s, n in enumerate(counts) if n)
        lengths = [0] * len(counts)
        if len(leaves) < 2:
            for _, s in leaves:
                lengths[s] = 1
            return lengths
        # Two queues in order of weight: what is left of the leaves, and the joined ones. A node's parent is noted.
        n, parent, none = len(leaves), [0] * (2 * len(leaves) - 1), float("inf")
        weights, joined = [w for w, _ in leaves] + [none], [none] * len(leaves)
        i = j = 0
        for k in range(n - 1):
            if weights[i] <= joined[j]:
                weight, parent[i], i = weights[i], n + k, i + 1
            else:
                weight, parent[n + j], j = joined[j], n + k, j + 1
            if weights[i] <= joined[j]:
                weight, parent[i], i = weight + weights[i], n + k, i + 1
            else:
                weight, parent[n + j], j = weight + joined[j], n + k, j + 1
            joined[k] = weight
        depth = [0] * (2 * n - 1)
        for x in range(2 * n - 3, -1, -1):
            depth[x] = depth[parent[x]] + 1
        if max(depth) <= 15:
            for (_, s), d in zip(leaves, depth, strict=False):
                lengths[s] = d
            return lengths
        counts = [-(-c // 4) for c in counts]


def put_counts(out: BitsOut, counts: list[int]) -> list[int]:
    """Writes the code for symbols of these counts; returns how many bits each takes."""
    used = [s for s, n in enumerate(counts) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        put_one(out, used[0] if used else 0)
        return [0] * len(counts)
    if len(used) == 1:  # beyond what a code of one symbol can name
        counts = [1, *counts[1:]]
    lengths = code_lengths(counts)
    put_lengths(out, lengths)
    return lengths


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Codes, first bit lowest, by the lengths of their symbols; each row is a prefix code of its own."""
    codes = np.zeros(lengths.shape, np.int64)
    row, symbol = np.nonzero(lengths)
    size = lengths[row, symbol].astype(np.int64)
    key = row * 16 + size
    order = np.argsort(key, kind="stable")
    many = np.bincount(key, minlength=16 * len(lengths)).reshape(-1, 16)
    first = np.zeros_like(many)
    for n in range(2, 16):
        first[:, n] = (first[:, n - 1] + many[:, n - 1]) << 1
    many = many.ravel()
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key)) - np.repeat(np.cumsum(many) - many, many)
    codes[row, symbol] = _backwards().take(first.ravel().take(key) + rank) >> (15 - size)
    return codes


def put_prefix_code(out: BitsOut, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the code for symbols of these counts; returns each symbol's code, first bit lowest, and its length."""
    lengths = np.array(put_counts(out, counts.tolist()))
    return codes_of(lengths[None])[0], lengths


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lengths or distances the prefix, the extra bits and how many they are."""
    v = values - 1
    high = np.maximum(np.frexp(np.maximum(v, 1).astype(float))[1] - 1, 1)
    extra = np.where(v < 4, 0, high - 1)
    prefix = np.where(v < 4, v, 2 * high + (v >> extra & 1))
    return prefix, v & ((1 << extra) - 1), extra


#: Back-references of fewer pixels are not made; of grey pixels, SEED equal ones are looked for. The cache has so many bits if it holds one pixel in CACHE_PAYS.
LEAST_COPY, SEED, MOST_COPY, CACHE_BITS, CACHE_PAYS = 3, 8, 4096, 6, 8


def _copies(px: np.ndarray, grey: bool) -> list[tuple[int, int, int]]:
    """(place, length, distance) of back-references, from left to right: the latest place at which the next pixels (2, SEED grey ones) stood before."""
    seed, n = (SEED, len(px)) if grey else (2, len(px))
    green = px.view(np.uint8)[1::4] if grey else px
    wide = green.astype(np.uint64)
    step = 8 if grey else 32
    keys, k = wide, 1
    while k < seed:  # seeds are powers of 2
        keys = keys[:-k] | keys[k:] << np.uint64(step * k)
        k *= 2
    order = np.argsort(keys)
    found = keys[order]
    same = found[1:] == found[:-1]
    if not same.any():
        return []
    again = np.zeros(len(keys), bool)  # only places whose keys are met again are put in order
    again[1:] = same
    again[:-1] |= same
    order = np.sort(order[again])
    order = order[np.argsort(keys[order], kind="stable")]
    found = keys[order]
    same = found[1:] == found[:-1]
    places, befores = order[1:][same], order[:-1][same]
    before = np.full(n, -1)
    before[places] = befores
    places = np.flatnonzero(before >= 0)
    out, end = [], 0
    raw = green.tobytes() if grey else b""
    for i, j in zip(places.tolist(), before[places].tolist(), strict=True):
        if i < end:
            continue
        most, length, step = min(n - i, MOST_COPY), seed, 32
        if grey:  # a stretch of equal bytes, in its end one by one
            while length + step <= most and raw[i + length : i + length + step] == raw[j + length : j + length + step]:
                length += step
                step *= 4
            stop = min(most, length + step)
            differ = int.from_bytes(raw[i + length : i + stop], "little") ^ int.from_bytes(raw[j + length : j + length + stop - length], "little")
            if differ:
                out.append((i, length + ((differ & -differ).bit_length() - 1) // 8, i - j))
                end = i + out[-1][1]
                continue
            length = stop
        while length < most:
            size = min(step, most - length)
            wrong = px[i + length : i + length + size] != px[j + length : j + length + size]
            at = int(wrong.argmax())
            if wrong[at]:
                length += at
                break
            length += size
            step *= 4
        if length >= LEAST_COPY:
            out.append((i, length, i - j))
            end = i + length
    return out


def put_image(out: BitsOut, argb: np.ndarray, main: bool, grey: bool = False) -> None:
    """Entropy-coded pixels, a row after the other; grey ones differ in green alone."""
    px = argb.ravel().astype(np.uint32)
    n = len(px)
    copies = _copies(px, grey) if n > 8 else []
    free = np.ones(n, bool)
    for at, length, _ in copies:
        free[at : at + length] = False
    alone = np.flatnonzero(free)
    cache_bits = 0
    if n >= 64 and not grey:
        slot = (px * np.uint32(HASH) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        held = np.zeros(n, bool)  # every pixel is put into the cache, so a pixel is there if the latest of its slot is equal
        held[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (px[order[1:]] == px[order[:-1]])
        if held[alone].sum() * CACHE_PAYS >= max(1, len(alone)):
            cache_bits = CACHE_BITS
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    # Tokens in order of place, then their parts: green, red, blue, alpha or length, distance.
    cached = alone[held[alone]] if cache_bits else alone[:0]
    plain = alone[~held[alone]] if cache_bits else alone
    places, length, far = np.array(copies, np.int64).reshape(-1, 3).T
    prefix, extra, extra_n = _prefixed(np.concatenate([length, far + 120]))
    (length, far), (length_bits, far_bits), (length_n, far_n) = (np.split(a, [len(places)]) for a in (prefix, extra, extra_n))
    channel = lambda shift: (px[plain] >> np.uint32(shift) & np.uint32(0xFF)).astype(np.int64)
    first = [channel(8), 256 + length, 280 + slot[cached] if cache_bits else cached]
    rest = [channel(16), channel(0), channel(24)] if not grey else [np.zeros(0, np.int64)] * 3
    coded = [put_prefix_code(out, np.bincount(np.concatenate(first), minlength=280 + (1 << cache_bits if cache_bits else 0)))]
    if grey:  # the other channels are the same in all pixels: codes of one symbol
        for shift in (16, 0, 24):
            put_one(out, int(px[0]) >> shift & 0xFF)
    else:
        coded += [put_prefix_code(out, np.bincount(v, minlength=256)) for v in rest]
    coded.append(put_prefix_code(out, np.bincount(far, minlength=40)))
    parts = [(plain, 0, coded[0], first[0]), *((plain, 1 + k, coded[1 + k], v) for k, v in enumerate(rest) if not grey), (cached, 0, coded[0], first[2]), (places, 0, coded[0], first[1]), (places, 2, coded[-1], far)]
    parts = [part for part in parts if len(part[0]) and part[2][1].any()]  # a code of one symbol takes no bits
    key = [at * 4 + k for at, k, _, _ in parts] + [places * 4 + 1, places * 4 + 3]
    value = [c[v] for _, _, (c, _), v in parts] + [length_bits, far_bits]
    width = [w[v] for _, _, (_, w), v in parts] + [length_n, far_n]
    values, widths = np.zeros(4 * n, np.int64), np.zeros(4 * n, np.int64)
    for k, v, w in zip(key, value, width, strict=True):
        values[k], widths[k] = v, w
    order = np.flatnonzero(widths)
    out.put_all(values[order], widths[order])


@functools.cache
def _weights() -> np.ndarray:
    """n times its binary logarithm, for n below 65536."""
    n = np.arange(1 << 16)
    return n * np.log2(np.maximum(n, 1))


def _reckoned(ways: dict[str, tuple[list[np.ndarray], tuple, int]]) -> dict[str, float]:
    """For each way the bits of its samples if each channel, given once for all ways that have it, had a best code, and what it needs besides."""
    channels = {id(c): c for each, _, _ in ways.values() for c in each}
    sizes = [c.size for c in channels.values()]
    flat = np.concatenate([c.ravel() for c in channels.values()]) + np.repeat(np.arange(0, 256 * len(sizes), 256, dtype=np.int16), sizes)
    n = np.bincount(flat, minlength=256 * len(sizes)).reshape(-1, 256)
    weigh = _weights().take if max(sizes) < 1 << 16 else lambda n: n * np.log2(np.maximum(n, 1))
    whole = np.array(sizes)
    bits = dict(zip(channels, (weigh(whole) - weigh(n).sum(1) + 6 * np.count_nonzero(n, axis=1)).tolist(), strict=True))
    return {w: sum(bits[id(c)] for c in each) + more for w, (each, _, more) in ways.items()}


def _slope(a: np.ndarray, b: np.ndarray) -> int:
    """The multiplier, in 32nds, by which a tells most of b; both signed."""
    square = float(np.einsum("i,i", a, a))  # in this thread; BLAS would take others for long ones
    return max(-128, min(127, round(32 * float(np.einsum("i,i", a, b)) / square))) if square else 0


def _residuals(samples: np.ndarray, mode: int) -> np.ndarray:
    """samples (row, column) less their neighbours to the left (1) or above (2)."""
    out = samples.copy()
    out[0, 1:] -= samples[0, :-1]
    out[1:, 0] -= samples[:-1, 0]
    out[1:, 1:] -= samples[1:, :-1] if mode == 1 else samples[:-1, 1:]
    return out


def _packed(index: np.ndarray, n: int) -> np.ndarray:
    """Indices into n colours as green values, several to a pixel if they are few."""
    per_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    per = 1 << per_bits
    packed = np.zeros((index.shape[0], -(-index.shape[1] // per)), np.uint8)
    for k in range(per):
        column = index[:, k::per]
        packed[:, : column.shape[1]] |= (column << (k * (8 >> per_bits))).astype(np.uint8)
    return packed


def _argb(alpha: int, samples: np.ndarray) -> np.ndarray:
    """Pixels of samples blue, green, red, or of green alone."""
    out = np.zeros((*samples.shape[:2], 4), np.uint8)
    out[..., 3] = alpha
    if samples.shape[-1] == 1:
        out[..., 1] = samples[..., 0]
    else:
        out[..., :3] = samples
    return out.view("<u4")[..., 0]


def transformed(argb: np.ndarray) -> tuple[str, np.ndarray, tuple, float]:
    """The shortest as reckoned: name, pixels to be coded, what the transform needs, and the bits reckoned."""
    px = np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)
    blue, green, red = (np.ascontiguousarray(px[..., k]) for k in range(3))
    ways: dict[str, tuple[list[np.ndarray], tuple, int]] = {"none": ([blue, green, red], (), 0)}
    ways["green"] = ([blue - green, green, red - green], (), 3)
    b, g, r = (c.ravel().view(np.int8).astype(float) for c in (blue, green, red))
    by = (_slope(g, r), _slope(g, b), _slope(r, b))
    delta = lambda m, v: (m * v.view(np.int8).astype(np.int16) >> 5).astype(np.uint8)
    ways["colour"] = ([blue - delta(by[1], green) - delta(by[2], red), green, red - delta(by[0], green)], by, 60)
    for mode in (1, 2):
        ways[f"predict{mode}"] = ([_residuals(c, mode) for c in (blue, green, red)], (mode,), 60)
    colours = np.unique(argb)
    if len(colours) <= 256:
        index = _packed(np.searchsorted(colours, argb), len(colours))
        ways["palette"] = ([none := np.zeros_like(index), index, none], (colours,), 24 * len(colours) + 40)
    bits = _reckoned(ways)
    name = min(bits, key=bits.get)
    return name, _argb(0 if name.startswith("predict") else 255, np.stack(ways[name][0], -1)), ways[name][1], bits[name]


def grey_transformed(grey: np.ndarray) -> tuple[str, np.ndarray, tuple, float]:
    """The same for grey samples (row, column), of which one channel is coded."""
    ways: dict[str, tuple[list[np.ndarray], tuple, int]] = {"green": ([grey], (), 3)}
    for mode in (1, 2):
        ways[f"predict{mode}"] = ([_residuals(grey, mode)], (mode,), 63)
    values = np.flatnonzero(np.bincount(grey.ravel(), minlength=256))
    if len(values) <= 16:
        colours = np.uint32(0xFF000000) | values.astype(np.uint32) * np.uint32(0x010101)
        ways["palette"] = ([_packed(np.searchsorted(values, grey), len(values))], (colours,), 24 * len(values) + 40)
    bits = _reckoned(ways)
    name = min(bits, key=bits.get)
    return name, _argb(0 if name.startswith("predict") else 255, ways[name][0][0][..., None]), ways[name][1], bits[name]


def encode(samples: bytes) -> bytes:
    """An image of 8-bit samples, a positive multiple of 192 of them: red, green, blue in rows of 64 pixels, or grey in rows of 192."""
    flat = np.frombuffer(samples, np.uint8)
    colour = flat.reshape(-1, WIDTH, 3)
    name, px, needs, bits = transformed(_argb(255, colour[..., ::-1]))
    if grey := (other := grey_transformed(flat.reshape(-1, GREY_WIDTH)))[3] < bits:
        name, px, needs, _ = other
    out = BitsOut()
    _put_head(out, name, needs, len(colour), bool(grey))
    put_image(out, px, True, grey)
    return container(out.bytes())


def _put_head(out: BitsOut, name: str, needs: tuple, rows: int, grey: bool) -> None:
    """All that comes before the pixels."""
    width = GREY_WIDTH if grey else WIDTH
    out.put(SIGNATURE | (width - 1) << 8 | (rows - 1) << 22, 40)
    if name in ("predict1", "predict2", "colour"):
        side = 9  # the largest blocks
        out.put(1, 1)
        out.put(name == "colour", 2)
        out.put(side - 2, 3)
        shape = (-(-rows >> side), -(-width >> side))
        value = needs[0] << 8 if name != "colour" else (needs[2] & 0xFF) << 16 | (needs[1] & 0xFF) << 8 | needs[0] & 0xFF
        put_image(out, np.full(shape, 0xFF000000 | value, np.uint32), False)
    if name == "palette":
        out.put(1, 1)
        out.put(3, 2)
        out.put(len(needs[0]) - 1, 8)
        steps = _split(needs[0][None])
        steps[:, 1:] -= steps[:, :-1].copy()
        put_image(out, _join(steps & 0xFF), False)
    elif grey or name == "green":
        out.put(1, 1)
        out.put(2, 2)
    out.put(0, 1)


# Many images at once. What they store is that of encode and decode one by one, without the small steps for each.

#: So many samples are written together, so many bytes read; images of LARGE samples or bytes and more go alone. PLACE bits hold a place among those together.
TOGETHER, READ_TOGETHER, LARGE, PLACE = 1 << 17, 1 << 14, 1 << 16, 22


def _groups(sizes: list[int], most: int) -> Iterator[list[int]]:
    """Indices of what goes together, in order."""
    group, held = [], 0
    for k, n in enumerate(sizes):
        if group and held + n > most:
            yield group
            group, held = [], 0
        group.append(k)
        held += n
    if group:
        yield group


def _residuals_together(samples: np.ndarray, begin: np.ndarray, mode: int) -> np.ndarray:
    """_residuals of images below one another, which begin at these rows."""
    out = samples.copy()
    if mode == 1:
        out[:, 1:] -= samples[:, :-1]
        out[1:, 0] -= samples[:-1, 0]
        out[begin, 0] = samples[begin, 0]
    else:
        out[1:] -= samples[:-1]
        out[begin] = samples[begin]
        out[begin, 1:] -= samples[begin, :-1]
    return out


def _grey_ways(flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each image the grey way reckoned shortest (0 green, 1 and 2 predicted), or -1 where it may be another; and the samples by way."""
    n, begin = len(rows), np.cumsum(rows) - rows
    base = np.repeat(np.arange(0, 256 * n, 256), rows)[:, None]
    red, green, blue = (np.ascontiguousarray(flat.reshape(-1, WIDTH, 3)[..., k]) for k in range(3))
    weigh = _weights()

    def counts(c: np.ndarray) -> np.ndarray:
        return np.bincount((c + base).ravel(), minlength=256 * n).reshape(n, 256)

    def bits(each: np.ndarray, samples: np.ndarray) -> np.ndarray:
        return weigh.take(samples) - weigh.take(each).sum(1) + 6 * np.count_nonzero(each, axis=1)

    # Each as in transformed: sums in the same order, so that they round alike.
    third = rows * WIDTH
    of = [counts(c) for c in (blue, green, red)]
    b, g, r = (bits(c, third) for c in of)
    best = np.minimum(b + g + r, bits(counts(blue - green), third) + g + bits(counts(red - green), third) + 3)
    tell = lambda x, y: np.add.reduceat(np.einsum("ij,ij->i", x, y), begin, dtype=float)  # noqa: E731  # a row's sum is exact
    signed = lambda c: c.view(np.int8).astype(np.float32)
    sb, sg, sr = (signed(c) for c in (blue, green, red))
    gg, rr = tell(sg, sg), tell(sr, sr)
    slope = lambda product, square: np.clip(np.rint(32 * product / np.maximum(square, 1)), -128, 127).astype(np.int16).repeat(rows)[:, None]
    delta = lambda m, c: (m * c.view(np.int8) >> 5).astype(np.uint8)
    on_blue = blue - delta(slope(tell(sg, sb), gg), green) - delta(slope(tell(sr, sb), rr), red)
    best = np.minimum(best, bits(counts(on_blue), third) + g + bits(counts(red - delta(slope(tell(sg, sr), gg), green)), third) + 60)
    for mode in (1, 2):
        b, g, r = (bits(counts(_residuals_together(c, begin, mode)), third) for c in (blue, green, red))
        best = np.minimum(best, b + g + r + 60)
    grey = flat.reshape(-1, GREY_WIDTH)
    samples = [grey, *(_residuals_together(grey, begin, mode) for mode in (1, 2))]
    all_three = of[0] + of[1] + of[2]
    reckoned = np.stack([bits(all_three, 3 * third) + 3, *(bits(counts(c), 3 * third) + 63 for c in samples[1:])])
    way, least = reckoned.argmin(0), reckoned.min(0)
    colours = red | green.astype(np.uint32) << 8 | blue.astype(np.uint32) << 16
    for at, more in zip(begin.tolist(), rows.tolist(), strict=True):
        colours[at : at + more].reshape(-1).sort()
    colours = colours.ravel()
    new = np.ones(len(colours), bool)
    new[1:] = colours[1:] != colours[:-1]
    new[begin * WIDTH] = True
    met = np.add.reduceat(new, begin * WIDTH, dtype=np.int64)
    # A palette of so many colours takes this at least: a code of its indices is shortest if all but one are met once.
    palette = np.where(met <= 16, 24 * met + 51, 30 * met + 51 + weigh.take(third) - weigh.take(third - met + 1))
    way[(least >= best) | (met <= 256) & (palette < least) | (np.count_nonzero(all_three, axis=1) <= 16)] = -1
    return way, samples


def _equal(raw: bytes, i: int, j: int, n: int, most: int) -> int:
    """How many bytes from i on are those from j on, n at least."""
    step = 32
    while n < most:
        stop = min(most, n + step)
        if raw[i + n : i + stop] != raw[j + n : j + stop]:
            differ = int.from_bytes(raw[i + n : i + stop], "little") ^ int.from_bytes(raw[j + n : j + stop], "little")
            return n + ((differ & -differ).bit_length() - 1) // 8
        n, step = stop, step * 4
    return most


def _copies_together(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_copies of grey images one after the other: places, lengths and distances."""
    total, ends = len(flat), np.cumsum(sizes)
    held = np.zeros(total + 40, np.uint8)
    held[:total] = flat
    keys = np.ndarray((total + 32,), "<u8", held, strides=(1,)).copy()  # SEED bytes from each place on
    # Mixed keys above, places below: sorted, equal keys lie in order of place. Keys that only mix alike are told apart after that.
    low = np.uint64((1 << PLACE) - 1)
    mixed = keys[:total] * np.uint64(0x9E3779B97F4A7C15) & ~low | np.arange(total, dtype=np.uint64)
    for end, n in zip(ends.tolist(), sizes.tolist(), strict=True):
        mixed[end - n : end - SEED + 1].sort()
    same = (mixed[1:] ^ mixed[:-1]) <= low
    same[np.minimum(ends[:, None] - SEED + np.arange(SEED), total - 2)] = False  # the last places have no key
    after = np.flatnonzero(same)
    i, j = (mixed[after + k] & low for k in (1, 0))
    before = np.full(total, -1)
    real = keys.take(i.view(np.int64)) == keys.take(j.view(np.int64))
    before[i[real].view(np.int64)] = j[real]
    is_place = before >= 0
    places = np.flatnonzero(is_place)
    before = before[places]
    most = np.minimum(np.repeat(ends, sizes)[places] - places, MOST_COPY)
    length, left = np.full(len(places), 4 * SEED), np.arange(len(places))
    for step in (SEED, 2 * SEED, 3 * SEED):
        differ = keys.take(places[left] + step) ^ keys.take(before[left] + step)
        ended = np.flatnonzero(differ)
        x = differ[ended]
        length[left[ended]] = step + (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
        left = left[differ == 0]
    length = np.minimum(length, most)
    rank = np.zeros(total + 1, np.int64)
    np.cumsum(is_place, out=rank[1:])
    taken, sizes_taken, raw = [], [], flat.tobytes()
    at, where, back, long, limit, n, k = memoryview(rank), memoryview(places), memoryview(before), memoryview(length), memoryview(most), len(places), 0
    while k < n:
        i, size = where[k], long[k]
        if size == 4 * SEED:
            size = _equal(raw, i, back[k], size, limit[k])
        taken.append(k)
        sizes_taken.append(size)
        k = at[i + size]
    taken = np.array(taken, np.int64)
    return places[taken], np.array(sizes_taken, np.int64), places[taken] - before[taken]


def _encode_greys(flat: np.ndarray, sizes: np.ndarray, ways: list[int]) -> list[bytes]:
    """Grey images one after the other, each of its way's samples."""
    n, total = len(sizes), len(flat)
    places, lengths, far = _copies_together(flat, sizes)
    prefix, extra, extra_n = _prefixed(np.concatenate([lengths, far + 120]))
    (lengths_p, far_p), (lengths_x, far_x), (lengths_n, far_n) = (np.split(a, [len(places)]) for a in (prefix, extra, extra_n))
    step = np.zeros(total + 1, np.int8)
    step[places] = 1
    step[places + lengths] -= 1
    token = np.cumsum(step[:-1], dtype=np.int8) == 0
    token[places] = True
    tokens = np.flatnonzero(token)
    is_copy = np.searchsorted(tokens, places)
    image = np.repeat(np.arange(n), np.diff(np.searchsorted(tokens, np.cumsum(sizes)), prepend=0))
    symbol = flat.take(tokens).astype(np.int64)
    symbol[is_copy] = 256 + lengths_p
    symbol += image * 280
    far_p += image[is_copy] * 40
    of_green = np.bincount(symbol, minlength=280 * n).reshape(n, 280)
    of_far = np.bincount(far_p, minlength=40 * n).reshape(n, 40)
    heads, head_bits, of_lengths, of_far_lengths = [], [], [], []
    of_green, of_far = of_green.tolist(), of_far.tolist()
    for k, way in enumerate(ways):
        out = BitsOut()
        _put_head(out, "predict%d" % way if way else "green", (way,), int(sizes[k]) // GREY_WIDTH, True)
        out.put(0, 2)
        of_lengths.append(bytes(put_counts(out, of_green[k])))
        for same in (0, 0, 0 if way else 255):
            put_one(out, same)
        of_far_lengths.append(bytes(put_counts(out, of_far[k])))
        heads.append(out.bytes())
        head_bits.append(8 * sum(map(len, out.done)) + out.n)
    green_width, width = (np.frombuffer(b"".join(of), np.uint8).astype(np.int64).reshape(n, -1) for of in (of_lengths, of_far_lengths))
    value, wide, code = codes_of(green_width).take(symbol).view(np.uint64), green_width.take(symbol), codes_of(width)
    # A back-reference in one: length, its extra bits, distance, its extra bits; 55 bits at most.
    v, w = value[is_copy], wide[is_copy]
    for more, size in ((lengths_x, lengths_n), (code.take(far_p), width.take(far_p)), (far_x, far_n)):
        v |= more.astype(np.uint64) << w.astype(np.uint64)
        w += size
    value[is_copy], wide[is_copy] = v, w
    # Each image in words of 64 bits of its own, its head before.
    ends = np.cumsum(wide)
    last = np.searchsorted(image, np.arange(n), "right") - 1
    bits = np.diff(ends[last], prepend=0) + head_bits
    words = (bits >> 6) + 1
    begin = np.cumsum(words) - words
    starts = ends - wide + (begin * 64 + head_bits - (ends[last] - bits + head_bits))[image]
    word, shift = starts >> 6, (starts & 63).view(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    packed = np.zeros(int(words.sum()) + 1, np.uint64)
    packed[word[first]] = np.bitwise_or.reduceat(value << shift, first)
    last = np.append(first[1:] - 1, len(word) - 1)  # of a word's tokens only the last one may reach into the next word
    last = last[(starts[last] & 63) + wide[last] > 64]
    packed[word[last] + 1] |= value[last] >> (np.uint64(64) - shift[last])
    stored, out = packed.astype("<u8", copy=False).view(np.uint8), []
    for head, at, n in zip(heads, (8 * begin).tolist(), bits.tolist(), strict=True):
        part = stored[at : at + -(-n // 8)].tobytes()
        joined = head[-1] | part[len(head) - 1] if len(part) >= len(head) else head[-1]
        out.append(container(head[:-1] + bytes([joined]) + part[len(head) :]))
    return out


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """encode of each."""
    out = [b""] * len(payloads)
    small = [k for k, p in enumerate(payloads) if len(p) < LARGE]
    for group in _groups([len(payloads[k]) for k in small], TOGETHER):
        group = [small[k] for k in group]
        flat = np.frombuffer(b"".join(payloads[k] for k in group), np.uint8)
        rows = np.array([len(payloads[k]) for k in group]) // GREY_WIDTH
        way, samples = _grey_ways(flat, rows)
        row_way = way.repeat(rows)
        chosen = samples[0].copy() if row_way.any() else samples[0]
        for mode in (1, 2):
            if (mine := row_way == mode).any():
                chosen[mine] = samples[mode][mine]
        grey = np.flatnonzero(way >= 0)
        if len(grey):
            for k, stored in zip(grey.tolist(), _encode_greys(chosen[row_way >= 0].ravel(), rows[grey] * GREY_WIDTH, way[grey].tolist()), strict=True):
                out[group[k]] = stored
    return [stored or encode(p) for stored, p in zip(out, payloads, strict=True)]


_HELD = [np.zeros((5, 0), np.int64), np.zeros(0, np.int64)]


def _scratch(n: int) -> np.ndarray:
    """Five rows of n numbers, in memory that is used again."""
    if _HELD[0].shape[1] < n:
        _HELD[0] = np.zeros((5, n), np.int64)
    return _HELD[0][:, :n]


def _places(n: int) -> np.ndarray:
    if len(_HELD[1]) < n:
        _HELD[1] = np.arange(n)
    return _HELD[1][:n]


def _follow(images: list[tuple[bytes, int, Code, Code, int, int]]) -> list[bytes]:
    """Green of images that have no other channel: of each the stream, the bit where pixels begin, codes of green and distances, pixels, width."""
    n, pad, skip = len(images), TOKEN // 8, [place >> 3 for _, place, *_ in images]
    parts = [data[k:] for (data, *_), k in zip(images, skip, strict=True)]
    sizes = np.array([len(part) + pad for part in parts])
    begin = np.cumsum(sizes) - sizes
    stream = np.frombuffer(b"".join(part + bytes(pad) for part in parts) + b"\0\0\0", np.uint8).astype(np.int64)
    four = stream[:-3] | stream[1:-2] << 8 | stream[2:-1] << 16 | stream[3:] << 24
    masks, tables = [], []
    for which in (2, 3):
        mask, symbols, lengths = zip(*(image[which].table() for image in images), strict=True)
        table = [s << 4 | k for s, k in zip(symbols, lengths, strict=True)]
        at = np.cumsum([0, *map(len, table[:-1])])
        masks.append((np.array(mask).repeat(sizes), at.repeat(sizes)))
        tables.append(np.concatenate(table).astype(np.int64))
    ahead = lambda at: four.take(at >> 3) >> (at & 7)
    (mask, base), (far_mask, far_base) = masks
    end = 8 * len(four)
    key, entry, one, two, four_on = _scratch(end + TOKEN)
    by_byte = key[:end].reshape(-1, 8)
    np.right_shift(four[:, None], np.arange(8), out=by_byte)
    by_byte &= mask[:, None]
    by_byte += base[:, None]
    entry = np.take(tables[0], key[:end], out=entry[:end], mode="clip")  # of each bit the symbol of a token that begins there, and the length of its code
    one[:] = _places(end + TOKEN)
    one[:end] += np.bitwise_and(entry, 15, out=key[:end])
    copies = np.flatnonzero(entry >= 256 << 4)
    at = np.minimum(one[copies], end - 64)
    grows, extra = _values((entry[copies] >> 4) - 256, ahead(at))
    at += extra
    found = tables[1].take((ahead(at) & far_mask[at >> 3]) + far_base[at >> 3])
    at += found & 15
    far, extra = _values(found >> 4, ahead(at))
    one[copies] = at + extra
    np.take(one, one, out=two, mode="clip")
    np.take(two, two, out=four_on, mode="clip")
    seen, counts, to = [], [], memoryview(np.take(four_on, four_on, out=key, mode="clip"))
    follow, stops = seen.append, [8 * (k + len(part)) for k, part in zip(begin.tolist(), parts, strict=True)]
    for (_, place, _, _, total, _), start, stop in zip(images, (8 * begin).tolist(), stops, strict=True):
        at, before = start + (place & 7), len(seen)
        for _ in range(-(-total // 8)):  # every token makes a pixel at least
            follow(at)
            at = to[at]
            if at >= stop:
                break
        counts.append(len(seen) - before)
    tokens = np.empty((len(seen), 8), np.int64)
    tokens[:, 0] = seen
    tokens[:, 4] = four_on.take(tokens[:, 0])
    tokens[:, 2::4] = two.take(tokens[:, ::4])
    tokens[:, 1::2] = one.take(tokens[:, ::2])
    tokens = np.minimum(tokens.ravel(), end - 1)
    count = 8 * np.array(counts)
    kind = entry.take(tokens) >> 4
    made = np.ones(len(tokens), np.int64)
    is_copy = np.flatnonzero(kind >= 256)
    which = np.searchsorted(copies, tokens[is_copy])
    made[is_copy] = grows[which]
    ends, last = np.cumsum(made), np.cumsum(count)
    totals = np.array([image[4] for image in images])
    starts = ends - made - np.repeat(ends[last - count] - made[last - count], count)  # in its image
    inside = starts < np.repeat(totals, count)
    image = np.repeat(np.arange(n), count)
    last = last - count + np.bincount(image[inside], minlength=n) - 1
    if (one[tokens[last]] > stops).any() or (starts[last] + made[last] < totals).any():
        raise ValueError("the stream ends too early")
    if (starts[last] + made[last] > totals).any():
        raise ValueError("a back-reference leaves the image")
    first = np.cumsum(totals) - totals
    out = np.zeros(int(totals.sum()), np.uint8)
    out[(starts + first[image])[inside]] = kind[inside]
    real = inside[is_copy]
    is_copy, back = is_copy[real], far[which[real]]
    image, starts, made = image[is_copy], starts[is_copy], made[is_copy]
    width = np.array([w for *_, w in images])[image]
    near = _near_array()[np.minimum(back, 120) - 1]
    back = np.where(back > 120, back - 120, np.maximum(1, near[:, 0] + near[:, 1] * width))
    if (back > starts).any():
        raise ValueError("a back-reference leaves the image")
    whole = bytearray(out)
    for at, length, back in zip((starts + first[image]).tolist(), made.tolist(), back.tolist(), strict=True):
        if back >= length:
            whole[at : at + length] = whole[at - back : at - back + length]
        else:  # it overlaps what it writes
            whole[at : at + length] = (whole[at - back : at] * (length // back + 1))[:length]
    return [bytes(whole[a : a + t]) for a, t in zip(first.tolist(), totals.tolist(), strict=True)]


def decode_greys(files: list[bytes]) -> list[bytes | None]:
    """Green of each image as wide as grey ones are, row by row; None where they have codes of other channels, cache, groups of codes or few pixels."""
    out: list[bytes | None] = [None] * len(files)
    heads = []
    for k, data in enumerate(files):
        if len(data) >= LARGE:
            continue
        bits = Bits(_chunk(data))
        width, height, _, undo = _read_head(bits)
        if (int.from_bytes(bits.data[1:3], "little") & 0x3FFF) + 1 != GREY_WIDTH or width * height < QUICK or bits.read(2):
            continue
        green, red, blue, alpha, distance = (read_code(bits, n) for n in (280, 256, 256, 256, 40))
        if green.one is None and None not in (red.one, blue.one, alpha.one):
            heads.append((k, (bits.data, bits.place(), green, distance, width * height, width), undo, alpha.one << 24 | red.one << 16 | blue.one, height))
    for group in _groups([len(files[head[0]]) for head in heads], READ_TOGETHER):
        for at, green in zip(group, _follow([heads[at][1] for at in group]), strict=True):
            k, _, undo, others, height = heads[at]
            if undo != [undo_subtract_green] and undo:
                argb = np.frombuffer(green, np.uint8).reshape(height, -1).astype(np.uint32) << 8 | np.uint32(others)
                for f in reversed(undo):
                    argb = f(argb)
                green = (argb >> 8).astype(np.uint8).tobytes()
            out[k] = green
    return out
