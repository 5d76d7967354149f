"""Blocks of integers in a stored, encoded form, and queries that read nothing but that form.

A block of consecutive keys becomes one row of ENCODED: its zone (lo, hi), a model of its keys
(base, slope, curve) and a payload of what the model leaves.  A codec is `model` or `model+coder`:
models are copy, for, delta, line (least squares), minimax, ends, median, quad and step; coders are
pack (bits of one width for the block), pack32 (a width for every 32 values), bytes (variable-length
bytes) and rans (variable-length bytes, entropy-coded).  key = base + floor(slope * i + curve * i^2)
+ residual for i from 0, residuals being made non-negative by the choice of base; `delta` stores
differences, folded to non-negative numbers, and a key is a sum of them.

Defined results: an empty table encodes to no rows; a block of one key has slope 0; keys must not
be null and span less than 2^62 in a block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encodings import blocks
from .ranking import asof

ENCODED = "block_id long, first_rank long, n int, codec string, lo long, hi long, base long, slope double, curve double, bits int, payload binary"
NAMES = [c.split()[0] for c in ENCODED.split(", ")]
MODELS = ("copy", "for", "delta", "line", "minimax", "ends", "median", "quad", "step")
CODERS = ("pack", "pack32", "bytes", "rans")


# Coders: arrays of unsigned 64-bit numbers to bytes and back.


def width_of(values: np.ndarray) -> int:
    return int(values.max()).bit_length() if len(values) else 0


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, one after the other, least bits first."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(data: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Values start..stop of packed data; only the bytes that hold them are read."""
    n = stop - start
    if n <= 0 or not width:
        return np.zeros(max(n, 0), np.uint64)
    first = start * width // 8
    part = np.frombuffer(data, np.uint8, (stop * width + 7) // 8 - first, first)
    bits = np.unpackbits(part, bitorder="little")[start * width - 8 * first :][: n * width].reshape(n, width)
    whole = np.zeros((n, 64), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u8").ravel()


def pack32(values: np.ndarray) -> bytes:
    groups = [values[i : i + 32] for i in range(0, len(values), 32)]
    widths = [width_of(g) for g in groups]
    return bytes(widths) + b"".join(pack(g, w) for g, w in zip(groups, widths, strict=True))


def unpack32(data: bytes, n: int) -> np.ndarray:
    groups, at, out = -(-n // 32), -(-n // 32), []
    for k in range(groups):
        size, width = min(32, n - 32 * k), data[k]
        out.append(unpack(data[at:], width, 0, size))
        at += (size * width + 7) // 8
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def to_bytes(values: np.ndarray) -> bytes:
    """Seven bits a byte, the least first; the high bit tells that more follow."""
    out = bytearray()
    for v in values.tolist():
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def from_bytes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    shift = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * shift).astype(np.uint64), starts) if len(ends) else np.zeros(0, np.uint64)


SCALE = 12  # bits of the sum of symbol frequencies
LOW = 1 << 23  # a state stays in [LOW, 256 * LOW)


def _frequencies(data: np.ndarray) -> np.ndarray:
    """Counts of the 256 symbols, scaled to sum to 2^SCALE; a symbol that occurs keeps 1 at least."""
    count = np.bincount(data, minlength=256)
    freq = np.where(count > 0, np.maximum(1, count * (1 << SCALE) // max(1, len(data))), 0)
    while (over := int(freq.sum()) - (1 << SCALE)) != 0:
        k = int(freq.argmax())
        freq[k] -= min(over, freq[k] - 1) if over > 0 else over
    return freq


def rans(data: bytes) -> bytes:
    """Range asymmetric numeral system over bytes: length, symbols with frequencies, last state, emitted bytes."""
    if not data:
        return b"\0\0\0\0"
    raw = np.frombuffer(data, np.uint8)
    freq = _frequencies(raw)
    base = np.cumsum(freq) - freq
    state, out, f, b = LOW, bytearray(), freq.tolist(), base.tolist()
    for s in reversed(data):
        top = (LOW >> SCALE << 8) * f[s]
        while state >= top:
            out.append(state & 255)
            state >>= 8
        state = (state // f[s] << SCALE) + state % f[s] + b[s]
    used = np.flatnonzero(freq)
    head = len(data).to_bytes(4, "little") + bytes([len(used) - 1]) + used.astype(np.uint8).tobytes() + freq[used].astype("<u2").tobytes()
    return head + state.to_bytes(4, "little") + bytes(reversed(out))


def unrans(data: bytes) -> bytes:
    n = int.from_bytes(data[:4], "little")
    if not n:
        return b""
    k = data[4] + 1
    used, freq = np.frombuffer(data, np.uint8, k, 5), np.frombuffer(data, "<u2", k, 5 + k)
    slot = np.repeat(np.arange(k), freq).tolist()
    base, at = (np.cumsum(freq.astype(int)) - freq).tolist(), 5 + 3 * k
    state, at, f, symbol = int.from_bytes(data[at : at + 4], "little"), at + 4, freq.tolist(), used.tolist()
    out = bytearray()
    for _ in range(n):
        low = state & (1 << SCALE) - 1
        i = slot[low]
        out.append(symbol[i])
        state = f[i] * (state >> SCALE) + low - base[i]
        while state < LOW and at < len(data):
            state = state << 8 | data[at]
            at += 1
    return bytes(out)


def elias_fano(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """(low bits, low parts packed, high parts) of ascending non-negative numbers: high parts are unary, a set bit for each number."""
    n = len(values)
    if not n:
        return 0, b"", b""
    low = max(0, (int(values[-1]) + 1).bit_length() - n.bit_length())
    at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1, np.uint8)
    high[at] = 1
    return low, pack(values & np.uint64((1 << low) - 1), low), np.packbits(high, bitorder="little").tobytes()


def from_elias_fano(low: int, packed: bytes, high: bytes, n: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Numbers start..stop: the place of a set bit less its number is the high part."""
    stop = n if stop is None else stop
    at = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little"))[start:stop]
    return ((at - np.arange(start, stop)).astype(np.uint64) << np.uint64(low)) | unpack(packed, low, start, stop)


# Models.


def minimax_slope(y: np.ndarray) -> float:
    """The slope of the line with the least largest error over (0, y[0]), (1, y[1]), ...

    That error is half the height of the hull over a vertical line, which a bridge of the upper or
    lower hull spans; the height is convex in the slope, so bisection over the slope's sign finds it.
    """
    x = np.arange(len(y), dtype=float)
    low, high = float(np.diff(y).min()), float(np.diff(y).max())
    for _ in range(100):
        s = (low + high) / 2
        r = y - s * x
        i, j = int(r.argmax()), int(r.argmin())
        if i == j or high - low <= 1e-12 * max(1.0, abs(s)):
            break
        low, high = (s, high) if i > j else (low, s)
    return (low + high) / 2


def fit(keys: np.ndarray, model: str) -> tuple[float, float]:
    """(slope, curve) of a model for the keys less their first."""
    n, y = len(keys), (keys - keys[0]).astype(float)
    if n < 2 or model in ("copy", "for", "delta"):
        return 0.0, 0.0
    x = np.arange(n, dtype=float)
    if model == "minimax":
        return minimax_slope(y), 0.0
    if model == "ends":
        return float(y[-1] / (n - 1)), 0.0
    if model == "median":  # outliers do not move it
        return float(np.median(np.diff(y))), 0.0
    if model == "step":
        return float(np.round(np.mean(np.diff(y)))), 0.0
    if model == "quad" and n > 2:
        curve, slope, _ = np.polyfit(x, y, 2)
        return float(slope), float(curve)
    centred = x - x.mean()
    return float((centred * y).sum() / (centred * centred).sum()), 0.0


def predicted(slope: float, curve: float, start: int, stop: int) -> np.ndarray:
    i = np.arange(start, stop, dtype=float)
    return np.floor(slope * i + curve * i * i).astype(np.int64)


def encode_block(keys: np.ndarray, codec: str) -> tuple:
    """(base, slope, curve, bits, payload)."""
    model, _, coder = codec.partition("+")
    coder = coder or "pack"
    slope, curve = fit(keys, model)
    if model == "copy":
        return 0, 0.0, 0.0, 64, keys.astype("<i8").tobytes()
    if model == "delta":
        d = np.diff(keys)
        base, rest = int(keys[0]), ((d << 1) ^ (d >> 63)).view(np.uint64)
    else:
        left = keys - predicted(slope, curve, 0, len(keys))
        base = int(left.min())
        rest = (left - base).view(np.uint64)
    bits = width_of(rest)
    if coder == "pack":
        return base, slope, curve, bits, pack(rest, bits)
    if coder == "pack32":
        return base, slope, curve, bits, pack32(rest)
    raw = to_bytes(rest)
    return base, slope, curve, bits, rans(raw) if coder == "rans" else raw


def residuals(r: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """What the payload of a row holds for places start..stop (of n - 1 differences for `delta`)."""
    model, _, coder = r["codec"].partition("+")
    n = r["n"] - (model == "delta")
    stop = n if stop is None else stop
    if (coder or "pack") == "pack":
        return unpack(r["payload"], r["bits"], start, stop)
    if coder == "pack32":
        return unpack32(r["payload"], n)[start:stop]
    return from_bytes(unrans(r["payload"]) if coder == "rans" else r["payload"])[start:stop]


def keys_of(r: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Keys at places start..stop of an encoded row."""
    stop = r["n"] if stop is None else stop
    model = r["codec"].partition("+")[0]
    if model == "copy":
        return np.frombuffer(r["payload"], "<i8", stop - start, 8 * start)
    if model == "delta":
        d = residuals(r, 0, stop - 1)
        d = (d >> np.uint64(1)).view(np.int64) ^ -(d & np.uint64(1)).view(np.int64)
        return (r["base"] + np.concatenate([[0], np.cumsum(d)])).astype(np.int64)[start:]
    return r["base"] + predicted(r["slope"], r["curve"], start, stop) + residuals(r, start, stop).view(np.int64)


def first_above(r: dict, cut: int) -> int:
    """The first place of an ascending block whose key is above `cut`; n if there is none.

    The line tells from where on that is possible, so only a part of the payload is read; delta and
    variable-length payloads are read from their start.
    """
    start = 0
    if r["slope"] > 0 and r["curve"] == 0 and r["codec"] not in ("copy", "delta"):
        start = min(r["n"], max(0, math.floor((cut - r["base"] - (1 << r["bits"])) / r["slope"]) - 1))
    return start + int(np.searchsorted(keys_of(r, start), cut, "right"))


# Tables.


def key_blocks(df: DataFrame, size: int) -> DataFrame:
    """(block_id, first_rank, keys): `size` consecutive keys of df (key, and what breaks ties) as one array."""
    b = blocks(df, size)
    rows = b.groupBy("block_id").agg(F.min("rank").alias("first_rank"), F.sort_array(F.collect_list(F.struct("idx", "key"))).alias("k"))
    return rows.select("block_id", "first_rank", F.col("k.key").alias("keys"))


def encode(arrays: DataFrame, codec: str | list[str] = "line") -> DataFrame:
    """ENCODED rows of (block_id, first_rank, keys); of several codecs the one of the fewest bytes, the first of equals.

    A column `codec` of arrays names a block's codec itself.
    """
    choices = [codec] if isinstance(codec, str) else list(codec)
    own = "codec" in arrays.columns

    def made(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                keys = np.array(r["keys"], np.int64)
                best = min(((c, encode_block(keys, c)) for c in ([r["codec"]] if own else choices)), key=lambda x: len(x[1][4]))
                rows.append((r["block_id"], r["first_rank"], len(keys), best[0], int(keys.min()), int(keys.max()), *best[1]))
            frame = pd.DataFrame(rows, columns=NAMES)
            yield pa.RecordBatch.from_pandas(frame.astype({"n": "int32", "bits": "int32"}), preserve_index=False)

    return arrays.mapInArrow(made, ENCODED)


ASCENDING = "block_id long, first_rank long, n int, base long, low int, packed binary, high binary"


def encode_ascending(arrays: DataFrame) -> DataFrame:
    """ASCENDING rows of (block_id, first_rank, keys) with ascending keys, as two parts of their bits."""

    def made(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                keys = np.array(r["keys"], np.int64)
                rows.append((r["block_id"], r["first_rank"], len(keys), int(keys[0]), *elias_fano((keys - keys[0]).view(np.uint64))))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in ASCENDING.split(", ")])
            yield pa.RecordBatch.from_pandas(frame.astype({"n": "int32", "low": "int32"}), preserve_index=False)

    return arrays.select("block_id", "first_rank", "keys").mapInArrow(made, ASCENDING)


def decode_ascending(encoded: DataFrame) -> DataFrame:
    """(rank, key) of ASCENDING rows."""

    def what(r):
        return r["first_rank"] + np.arange(r["n"]), r["base"] + from_elias_fano(r["low"], r["packed"], r["high"], r["n"]).view(np.int64)

    return _over_rows(encoded, "rank long, key long", what)


def stored_bytes(encoded: DataFrame) -> DataFrame:
    """(codec, blocks, n, n_bytes): payloads, and 30 bytes for the zone and the model of a block."""
    size = F.sum(F.octet_length("payload") + 30).cast("long")
    return encoded.groupBy("codec").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").cast("long").alias("n"), size.alias("n_bytes"))


def _over_rows(encoded: DataFrame, schema: str, what) -> DataFrame:
    """what(row) -> tuple of arrays, one for each column of schema, for each encoded row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def made(batches):
        for batch in batches:
            found = [what(r) for r in batch.to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names)

    return encoded.mapInArrow(made, schema)


def decode(encoded: DataFrame) -> DataFrame:
    """(rank, key) of all keys."""
    return _over_rows(encoded, "rank long, key long", lambda r: (r["first_rank"] + np.arange(r["n"]), keys_of(r)))


def above(encoded: DataFrame, cut: int) -> DataFrame:
    """(rank, key) with key > cut in ascending blocks: zones rule blocks out, the model gives the place to start at."""

    def what(r):
        start = first_above(r, cut)
        return r["first_rank"] + np.arange(start, r["n"]), keys_of(r, start) if start < r["n"] else np.zeros(0, np.int64)

    return _over_rows(encoded.filter(F.col("hi") > cut), "rank long, key long", what)


def modulo(encoded: DataFrame, base: int, low: int, high: int) -> DataFrame:
    """(rank, key) with low < key mod base < high; a block inside one period whose zone is outside is not decoded."""
    lo, hi = F.pmod("lo", F.lit(base)), F.pmod("hi", F.lit(base))
    out = (F.expr(f"lo div {base}") == F.expr(f"hi div {base}")) & (F.col("lo") >= 0) & ((lo >= high) | (hi <= low))

    def what(r):
        keys = keys_of(r)
        m = np.mod(keys, base)
        at = np.flatnonzero((m > low) & (m < high))
        return r["first_rank"] + at, keys[at]

    return _over_rows(encoded.filter(~out), "rank long, key long", what)


def gather(encoded: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rank, key) at the ranks of `wanted`: they meet their block, which is read at these places only."""
    lists = wanted.select("rank").distinct().groupBy(F.expr(f"rank div {size}").alias("b")).agg(F.collect_list("rank").alias("ranks"))
    held = encoded.join(lists, F.col("block_id") == F.col("b")).drop("b")

    def what(r):
        ranks = np.sort(np.array(r["ranks"], np.int64))
        at = ranks - r["first_rank"]
        ranks, at = ranks[at < r["n"]], at[at < r["n"]]
        if not len(at):
            return ranks, at
        return ranks, keys_of(r, int(at[0]), int(at[-1]) + 1)[at - at[0]]

    return _over_rows(held, "rank long, key long", what)


def sums(encoded: DataFrame) -> DataFrame:
    """(block_id, n, total): sums from the base, the line's values and the residuals; no key is rebuilt, except of differences."""

    def what(r):
        if r["codec"].partition("+")[0] in ("copy", "delta"):
            total = sum(keys_of(r).tolist())
        else:
            total = r["n"] * r["base"] + sum(predicted(r["slope"], r["curve"], 0, r["n"]).tolist()) + sum(residuals(r).tolist())
        return (np.array([r["block_id"]]), np.array([r["n"]]), np.array([str(total)], object))

    out = _over_rows(encoded, "block_id long, n long, total string", what)
    return out.withColumn("total", F.col("total").cast("decimal(38,0)"))


def upper_bound(encoded: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, upper): the number of keys at most the probe, by the zones and then inside one encoded block.

    Keys must ascend over the blocks.
    """
    at = asof(probes.select("probe"), encoded.select("lo", "block_id"), "probe", "lo", ["block_id"]).select("probe", "block_id")
    lists = at.filter("block_id is not null").groupBy(F.col("block_id").alias("b")).agg(F.collect_list("probe").alias("probes"))
    held = encoded.join(lists, F.col("block_id") == F.col("b")).drop("b")

    def what(r):
        probes = np.array(r["probes"], np.int64)
        return probes, r["first_rank"] + np.array([first_above(r, int(p)) for p in probes], np.int64)

    found = _over_rows(held, "probe long, upper long", what)
    return found.unionByName(at.filter("block_id is null").select("probe", F.lit(0).cast("long").alias("upper")))


def features(arrays: DataFrame) -> DataFrame:
    """arrays with numbers that tell which model fits: bits of the range, of the line's error, of the largest step, and bending."""
    columns = arrays.columns

    def made(batches):
        for batch in batches:
            rows = []
            for keys in batch.column("keys").to_pylist():
                k = np.array(keys, np.int64)
                y, d = (k - k[0]).astype(float), np.diff(k.astype(float))
                line = y - fit(k, "line")[0] * np.arange(len(k))
                bend = np.ptp(line[len(k) // 4 : 3 * len(k) // 4]) / max(1.0, np.ptp(line)) if len(k) > 3 else 0.0
                rows.append([math.log2(1 + np.ptp(y)), math.log2(1 + np.ptp(line)), math.log2(1 + (np.abs(d).max() if len(d) else 0.0)), float(bend)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(rows, pa.list_(pa.float64()))], [*columns, "features"])

    return arrays.mapInArrow(made, ", ".join([*(f"{c} {arrays.schema[c].dataType.simpleString()}" for c in columns), "features array<double>"]))


def choose_codecs(arrays: DataFrame, codecs: list[str], sample: int = 1000, depth: int = 4) -> DataFrame:
    """arrays with the `codec` that a decision tree over their features names.

    The tree is fitted on about `sample` blocks, chosen by a hash, labelled with the codec of their fewest bytes.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    told = features(arrays).withColumn("v", array_to_vector("features"))
    share = min(1 << 30, (sample << 30) // max(1, arrays.count()))
    some = told.filter(F.pmod(F.xxhash64("block_id"), F.lit(1 << 30)) < share)
    best = encode(some.select("block_id", "first_rank", "keys"), codecs).select("block_id", F.array_position(F.array(*[F.lit(c) for c in codecs]), F.col("codec")).alias("best"))
    train = some.join(best, "block_id").select("v", (F.col("best") - 1).cast("double").alias("label"))
    model = DecisionTreeClassifier(featuresCol="v", labelCol="label", predictionCol="p", maxDepth=depth, seed=1).fit(train)
    named = F.get(F.array(*[F.lit(c) for c in codecs]), F.col("p").cast("int"))
    return model.transform(told).select("block_id", "first_rank", "keys", named.alias("codec"))
