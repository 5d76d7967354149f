"""Codecs with variable-length blocks, strings as integers, symbol tables and prefix codes.

Each works on a block of rows, which the caller bounds; a decoder is given for each encoder.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "block_id long, start long, n long, base long, slope double, bits long, codes array<long>"
#: Bits that a piece's header takes: start, base, slope and width.
HEADER = 64 + 64 + 16 + 8


def encode_piece(y: np.ndarray, kind: str) -> tuple[int, float, int, np.ndarray]:
    """(base, slope, bits a value, codes): y as a line and offsets, or as its first value and deltas."""
    if kind == "delta":
        d = np.diff(y, prepend=y[:1])
        return int(y[0]), 0.0, _width(int(np.abs(d).max())) + 1, d
    slope = float(y[-1] - y[0]) / max(1, len(y) - 1)
    rest = y - np.floor(slope * np.arange(len(y))).astype(np.int64)
    base = int(rest.min())
    return base, slope, _width(int(rest.max()) - base), rest - base


def decode_piece(base: int, slope: float, codes: np.ndarray, kind: str) -> np.ndarray:
    if kind == "delta":
        return base + np.cumsum(codes)
    return base + codes + np.floor(slope * np.arange(len(codes))).astype(np.int64)


def _width(x: int) -> int:
    return x.bit_length()


def _cost(y: np.ndarray, kind: str) -> int:
    return HEADER + len(y) * encode_piece(y, kind)[2]


def cut_greedy(y: np.ndarray, kind: str, grain: int) -> list[int]:
    """Starts of pieces: each grows by a grain while that costs less than a new piece."""
    starts, at = [0], grain
    while at < len(y):
        stop = min(len(y), at + grain)
        if _cost(y[starts[-1] : stop], kind) > _cost(y[starts[-1] : at], kind) + _cost(y[at:stop], kind):
            starts.append(at)
        at = stop
    return starts


def cut_merge(y: np.ndarray, kind: str, grain: int) -> list[int]:
    """Starts of pieces: neighbours merge, the best saving first, until none saves."""
    starts = list(range(0, len(y), grain))
    while len(starts) > 1:
        ends = [*starts[1:], len(y)]
        each = [_cost(y[a:b], kind) for a, b in zip(starts, ends, strict=True)]
        saved = [each[i] + each[i + 1] - _cost(y[starts[i] : ends[i + 1]], kind) for i in range(len(starts) - 1)]
        i = int(np.argmax(saved))
        if saved[i] <= 0:
            break
        del starts[i + 1]
    return starts


def cut_best(y: np.ndarray, kind: str, grain: int) -> list[int]:
    """Starts of the cheapest pieces with cuts at multiples of the grain, by dynamic programming."""
    edges = [*range(0, len(y), grain), len(y)]
    best, back = [0], [0]
    for j in range(1, len(edges)):
        options = [best[i] + _cost(y[edges[i] : edges[j]], kind) for i in range(j)]
        back.append(int(np.argmin(options)))
        best.append(options[back[-1]])
    starts, j = [], len(edges) - 1
    while j:
        j = back[j]
        starts.append(edges[j])
    return starts[::-1]


CUTS = {"greedy": cut_greedy, "merge": cut_merge, "best": cut_best}


def pieces(b: DataFrame, cut: str = "greedy", kind: str = "line", grain: int = 16) -> DataFrame:
    """PIECES of blocks b (key, block_id, idx)."""

    def made(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("idx")
        y = x["key"].to_numpy(np.int64)
        starts = CUTS[cut](y, kind, grain)
        rows = []
        for a, z in zip(starts, [*starts[1:], len(y)], strict=True):
            base, slope, width, codes = encode_piece(y[a:z], kind)
            rows.append((x["block_id"].iloc[0], a, z - a, base, slope, width, codes))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return b.select("key", "block_id", "idx").groupBy("block_id").applyInPandas(made, PIECES)


def unpack(coded: DataFrame, kind: str = "line") -> DataFrame:
    """block_id, idx, key from PIECES, by column functions."""
    rows = coded.select("block_id", "start", "base", "slope", "codes", F.posexplode("codes").alias("i", "code"))
    if kind == "delta":
        key = F.col("base") + F.aggregate(F.slice("codes", 1, F.col("i") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    else:
        key = F.col("base") + F.col("code") + F.floor(F.col("slope") * F.col("i")).cast("long")
    return rows.select("block_id", (F.col("start") + F.col("i")).alias("idx"), key.alias("key"))


def piece_bits(coded: DataFrame) -> DataFrame:
    return coded.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(HEADER + F.col("n") * F.col("bits")).cast("long").alias("bits"))


# Strings as integers: digits in the base of the characters that occur, after the common prefix.


def alphabet(texts) -> str:
    return "".join(sorted(set().union(*texts))) if len(texts) else ""


def to_integer(text: str, chars: str, width: int) -> int:
    """Order-keeping among texts of `width` characters at most; digit 0 pads."""
    base, n = len(chars) + 1, 0
    for i in range(width):
        n = n * base + (chars.index(text[i]) + 1 if i < len(text) else 0)
    return n


def to_text(n: int, chars: str, width: int) -> str:
    base, out = len(chars) + 1, []
    for _ in range(width):
        n, digit = divmod(n, base)
        if digit:
            out.append(chars[digit - 1])
    return "".join(reversed(out))


def ascii_to_integer(text: str, width: int) -> int:
    """Seven bits a character, zero for padding; order-keeping among ASCII texts of `width` characters at most."""
    n = 0
    for i in range(width):
        n = n << 7 | (ord(text[i]) if i < len(text) else 0)
    return n


def integer_to_ascii(n: int, width: int) -> str:
    return "".join(chr(c) for i in reversed(range(width)) if (c := n >> 7 * i & 127))


def shifted_to_integer(text: str, least: str, greatest: str, width: int) -> int:
    """Digits are distances from the least character of a range, one more than that; zero pads."""
    base, n = ord(greatest) - ord(least) + 2, 0
    for i in range(width):
        n = n * base + (ord(text[i]) - ord(least) + 1 if i < len(text) else 0)
    return n


def integer_to_shifted(n: int, least: str, greatest: str, width: int) -> str:
    base, out = ord(greatest) - ord(least) + 2, []
    for _ in range(width):
        n, digit = divmod(n, base)
        if digit:
            out.append(chr(ord(least) + digit - 1))
    return "".join(reversed(out))


FORMS = ("ascii", "subset", "shifted")


def text_forms(texts: DataFrame, column: str, chars: str, width: int) -> DataFrame:
    """(form, text, code, back) of ASCII texts over `chars`, of `width` characters at most: integers as decimal strings, and the texts that they give."""
    least, greatest = min(chars), max(chars)
    to = {"ascii": lambda t: ascii_to_integer(t, width), "subset": lambda t: to_integer(t, chars, width), "shifted": lambda t: shifted_to_integer(t, least, greatest, width)}
    of = {"ascii": lambda n: integer_to_ascii(n, width), "subset": lambda n: to_text(n, chars, width), "shifted": lambda n: integer_to_shifted(n, least, greatest, width)}

    def made(batches):
        for x in batches:
            for form in FORMS:
                codes = [to[form](t) for t in x["text"]]
                yield pd.DataFrame({"form": form, "text": x["text"], "code": [str(c) for c in codes], "back": [of[form](c) for c in codes]})

    return texts.select(F.col(column).alias("text")).mapInPandas(made, "form string, text string, code string, back string")


STRINGS = "block_id long, prefix string, chars string, width int, base string, slope string, n long, codes array<string>"


def string_blocks(b: DataFrame, text: str) -> DataFrame:
    """STRINGS of blocks b (text, block_id, idx) sorted by text: integers as a line and non-negative offsets.

    Integers may have any length, so they are kept as decimal strings; the slope is an integer.
    """

    def made(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("idx")
        texts = x[text].tolist()
        prefix = texts[0]
        for t in (min(texts), max(texts)):
            while not t.startswith(prefix):
                prefix = prefix[:-1]
        rest = [t[len(prefix) :] for t in texts]
        chars, width = alphabet(rest), max(map(len, rest))
        y = [to_integer(t, chars, width) for t in rest]
        slope = (y[-1] - y[0]) // max(1, len(y) - 1)
        off = [v - slope * i for i, v in enumerate(y)]
        base = min(off)
        row = (x["block_id"].iloc[0], prefix, chars, width, str(base), str(slope), len(y), [str(v - base) for v in off])
        return pd.DataFrame([row], columns=[c.split()[0] for c in STRINGS.split(", ")])

    return b.select(text, "block_id", "idx").groupBy("block_id").applyInPandas(made, STRINGS)


def string_at(coded: DataFrame, wanted: DataFrame) -> DataFrame:
    """(block_id, idx, text) of the places wanted (block_id, idx): each is decoded alone."""

    def text(prefix: pd.Series, chars: pd.Series, width: pd.Series, base: pd.Series, slope: pd.Series, code: pd.Series, i: pd.Series) -> pd.Series:
        both = zip(prefix, chars, width, base, slope, code, i, strict=True)
        return pd.Series([p + to_text(int(b) + int(s) * int(k) + int(c), ch, int(w)) for p, ch, w, b, s, c, k in both], dtype=object)

    text.__annotations__ = dict.fromkeys(("prefix", "chars", "width", "base", "slope", "code", "i", "return"), pd.Series)
    at = coded.join(wanted, "block_id").withColumn("code", F.get("codes", F.col("idx").cast("int"))).filter("code is not null")
    return at.select("block_id", "idx", F.pandas_udf(text, "string")("prefix", "chars", "width", "base", "slope", "code", F.col("idx")).alias("text"))


# Symbol tables: up to 255 frequent byte strings of 1 to 8 bytes get a byte; 255 escapes a literal byte.

ESCAPE, MOST_SYMBOLS, MOST_BYTES = 255, 255, 8


def symbols(sample: list[bytes], rounds: int = 4) -> list[bytes]:
    """Symbols by rounds: encode the sample, count symbols and pairs of neighbours, keep the greatest savings."""
    table: list[bytes] = []
    for _ in range(rounds):
        seen: Counter = Counter()
        for s in sample:
            parts = split_symbols(s, table)
            seen.update(parts)
            seen.update(a + b for a, b in zip(parts, parts[1:], strict=False) if len(a) + len(b) <= MOST_BYTES)
        worth = sorted(seen, key=lambda p: (-seen[p] * len(p), p))
        table = worth[:MOST_SYMBOLS]
    return sorted(table, key=lambda p: (-len(p), p))


def split_symbols(s: bytes, table: list[bytes]) -> list[bytes]:
    """s as its longest known symbols, or single bytes."""
    known, out, i = set(table), [], 0
    while i < len(s):
        n = next((n for n in range(min(MOST_BYTES, len(s) - i), 1, -1) if s[i : i + n] in known), 1)
        out.append(s[i : i + n])
        i += n
    return out


def encode_symbols(s: bytes, table: list[bytes]) -> bytes:
    code = {p: i for i, p in enumerate(table)}
    return b"".join(bytes([code[p]]) if p in code else bytes([ESCAPE]) + p for p in split_symbols(s, table))


def decode_symbols(coded: bytes, table: list[bytes]) -> bytes:
    out, i = [], 0
    while i < len(coded):
        if coded[i] == ESCAPE:
            out.append(coded[i + 1 : i + 2])
            i += 2
        else:
            out.append(table[coded[i]])
            i += 1
    return b"".join(out)


def symbol_blocks(b: DataFrame, text: str) -> DataFrame:
    """block_id, table (array of binary), idx, coded, n_bytes of blocks b (text, block_id, idx), a table for each block."""

    def made(x: pd.DataFrame) -> pd.DataFrame:
        raw = [t.encode() for t in x[text]]
        table = symbols(raw)
        return pd.DataFrame({"block_id": x["block_id"], "idx": x["idx"], "n_bytes": [len(r) for r in raw], "coded": [encode_symbols(r, table) for r in raw], "table": [table] * len(raw)})

    return b.select(text, "block_id", "idx").groupBy("block_id").applyInPandas(made, "block_id long, idx long, n_bytes long, coded binary, table array<binary>")


def decode_symbol_rows(coded: DataFrame) -> DataFrame:
    def text(c: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([decode_symbols(bytes(x), [bytes(s) for s in y]).decode() for x, y in zip(c, t, strict=True)], dtype=object)

    text.__annotations__ = dict.fromkeys(("c", "t", "return"), pd.Series)
    return coded.select("block_id", "idx", "n_bytes", F.octet_length("coded").cast("long").alias("coded_bytes"), F.pandas_udf(text, "string")("coded", "table").alias("text"))


def code_lengths(counts: dict) -> dict:
    """Bits of each value in an optimal prefix code; a single value takes 1 bit."""
    heap = [(n, i, [v]) for i, (v, n) in enumerate(sorted(counts.items()))]
    length = dict.fromkeys(counts, 1 if len(counts) == 1 else 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for v in x + y:
            length[v] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    return length


def prefix_code_bits(b: DataFrame, value: str) -> DataFrame:
    """block_id, bits: what the values of each block take in their own prefix code; counts come first, in the JVM."""

    def made(x: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(x["v"].tolist(), x["n"].tolist(), strict=True))
        length = code_lengths(counts)
        return pd.DataFrame({"block_id": x["block_id"].iloc[:1], "bits": [sum(n * length[v] for v, n in counts.items())]})

    counted = b.groupBy("block_id", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("block_id").applyInPandas(made, "block_id long, bits long")
