"""Image stacks as rows: (path, shape [x, y, z, c], dtype, data), read from v3draw, v3dpbd, NPY, NRRD and
TIFF files and from tiled pyramids. Arrays are always in the order X, Y, Z, C.
"""

from __future__ import annotations

import gzip
import io
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, shape array<int>, dtype string, data binary"
RAW_KEY = b"raw_image_stack_by_hpeng"
PBD_KEY = b"v3d_volume_pkbitdf_encod"
_SHORT = {b"L": "<", b"B": ">"}
#: 16-bit difference codes: first code, bits of a difference, largest positive difference.
_STEPS = ((32, 80, 31, 3), (80, 183, 79, 4), (183, 223, 182, 5))


def xyzc(a: np.ndarray) -> np.ndarray:
    """A 3-D array gets one channel; others must have four axes."""
    if a.ndim == 3:
        a = a[..., None]
    if a.ndim != 4:
        raise ValueError(f"an image stack has 3 or 4 axes, not {a.ndim}")
    return a


def as_dtype(a: np.ndarray, dtype: str | None) -> np.ndarray:
    """Converted with scaling: unsigned integers span 0 .. 1 as floats."""
    if dtype is None or a.dtype == np.dtype(dtype):
        return a
    to = np.dtype(dtype)
    if a.dtype.kind == "u" and to.kind == "f":
        return (a / np.iinfo(a.dtype).max).astype(to)
    if a.dtype.kind == "f" and to.kind == "u":
        return np.clip(np.rint(a * np.iinfo(to).max), 0, np.iinfo(to).max).astype(to)
    if a.dtype.kind == "u" and to.kind == "u":
        return (a / np.iinfo(a.dtype).max * np.iinfo(to).max).round().astype(to)
    return a.astype(to)


def decode_v3draw(b: bytes) -> np.ndarray:
    if b[:24] != RAW_KEY:
        raise ValueError("not a v3draw file")
    e = _SHORT[b[24:25]]
    kind = struct.unpack_from(f"{e}h", b, 25)[0]
    if kind not in (1, 2, 4):
        raise ValueError("v3draw data must be of 1, 2 or 4 bytes")
    size = struct.unpack_from(f"{e}4i", b, 27)
    if 43 + kind * int(np.prod(size)) != len(b):
        raise ValueError("the size of the file does not match its header")
    a = np.frombuffer(b, f"{e}{'f4' if kind == 4 else f'u{kind}'}", offset=43).reshape(size[::-1])
    return a.transpose(3, 2, 1, 0)


def encode_v3draw(a: np.ndarray) -> bytes:
    """uint8, uint16 or float32 (x, y, z, c)."""
    a = xyzc(a)
    kind = {"u1": 1, "u2": 2, "f4": 4}[a.dtype.str[1:]]
    body = np.ascontiguousarray(a.transpose(3, 2, 1, 0)).astype(a.dtype.newbyteorder("<"))
    return RAW_KEY + b"L" + struct.pack("<h4i", kind, *a.shape) + body.tobytes()


def decode_v3dpbd(b: bytes) -> np.ndarray:
    """Lossless packed differences of 8 or 16 bits."""
    if b[:24] != PBD_KEY:
        raise ValueError("not a v3dpbd file")
    e = _SHORT[b[24:25]]
    kind = struct.unpack_from(f"{e}h", b, 25)[0]
    size = struct.unpack_from(f"{e}4i", b, 27)
    n = int(np.prod(size))
    out = _unpack8(b, 43, n) if kind == 1 else _unpack16(b, 43, n, e) if kind == 2 else None
    if out is None:
        raise ValueError("v3dpbd data must be of 1 or 2 bytes")
    return out.reshape(size[::-1]).transpose(3, 2, 1, 0)


def _unpack8(b: bytes, at: int, n: int) -> np.ndarray:
    out, p = np.zeros(n, np.uint8), 0
    step = np.array([0, 1, 2, -1])
    while at < len(b) and p < n:
        code = b[at]
        at += 1
        if code < 33:
            k = code + 1
            out[p : p + k] = np.frombuffer(b, np.uint8, k, at)
            at += k
        elif code < 128:
            k = code - 32
            packed = np.frombuffer(b, np.uint8, -(-k // 4), at)
            at += len(packed)
            d = step[(packed[:, None] >> np.array([0, 2, 4, 6]) & 3).ravel()[:k]]
            out[p : p + k] = (int(out[p - 1]) + np.cumsum(d)) & 255
        else:
            k = code - 127
            out[p : p + k] = b[at]
            at += 1
        p += k
    return out


def _unpack16(b: bytes, at: int, n: int, e: str) -> np.ndarray:
    out, p = np.zeros(n, np.uint16), 0
    while at < len(b) and p < n:
        code = b[at]
        at += 1
        if code < 32:
            k = code + 1
            out[p : p + k] = np.frombuffer(b, f"{e}u2", k, at)
            at += 2 * k
        elif code < 223:
            lo, _, base, width = next(s for s in _STEPS if s[0] <= code < s[1])
            k = code - base
            size = -(-k * width // 8)
            bits = np.unpackbits(np.frombuffer(b, np.uint8, size, at))[: k * width].reshape(k, width)
            at += size
            d = bits @ (1 << np.arange(width - 1, -1, -1))
            top = 1 << (width - 1)
            d = np.where(d > top, top - d, d)
            out[p : p + k] = (int(out[p - 1]) + np.cumsum(d)) & 0xFFFF
        else:
            k = code - 222
            out[p : p + k] = struct.unpack_from(f"{e}H", b, at)[0]
            at += 2
        p += k
    return out


def encode_v3dpbd8(a: np.ndarray) -> bytes:
    """uint8 (x, y, z, c): runs of equal bytes, else literals."""
    a = xyzc(a)
    flat = np.ascontiguousarray(a.transpose(3, 2, 1, 0)).ravel()
    out, i, n = bytearray(PBD_KEY + b"L" + struct.pack("<h4i", 1, *a.shape)), 0, len(flat)
    cuts = np.append(np.flatnonzero(np.diff(flat)) + 1, n)
    literal: list[int] = []

    def flush() -> None:
        for k in range(0, len(literal), 33):
            part = literal[k : k + 33]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for c in cuts.tolist():
        v, k = int(flat[i]), c - i
        if k < 3:
            literal += [v] * k
        else:
            flush()
            for m in range(0, k, 128):
                out += bytes([127 + min(128, k - m), v])
        i = c
    flush()
    return bytes(out)


def decode_npy(b: bytes) -> np.ndarray:
    return xyzc(np.load(io.BytesIO(b), allow_pickle=False))


def decode_nrrd(b: bytes) -> np.ndarray:
    """NRRD with raw, gzip or ASCII data in the same file; three axes, or channels first."""
    end = b.find(b"\n\n")
    skip = 2
    if end < 0 or 0 <= b.find(b"\r\n\r\n") < end:
        end, skip = b.find(b"\r\n\r\n"), 4
    if not b.startswith(b"NRRD") or end < 0:
        raise ValueError("not an NRRD file")
    head = {}
    for line in b[:end].decode("ascii", "replace").splitlines()[1:]:
        if ":" in line and not line.startswith("#"):
            k, v = line.split(":", 1)
            head[k.strip().lower()] = v.lstrip("=").strip()
    names = {"uchar": "u1", "uint8": "u1", "unsigned char": "u1", "ushort": "u2", "uint16": "u2", "unsigned short": "u2", "uint": "u4", "uint32": "u4", "float": "f4", "double": "f8", "short": "i2", "int16": "i2", "int": "i4", "int32": "i4"}
    kind = np.dtype(names[head["type"].lower()])
    if kind.itemsize > 1 and head.get("endian", "little") == "big":
        kind = kind.newbyteorder(">")
    body = b[end + skip :]
    coding = head.get("encoding", "raw").lower()
    sizes = [int(v) for v in head["sizes"].split()]
    if coding in ("gzip", "gz"):
        body = gzip.decompress(body)
    if coding in ("ascii", "txt", "text"):
        a = np.array(body.split(), kind)
    else:
        a = np.frombuffer(body, kind, int(np.prod(sizes)))
    a = a.reshape(sizes, order="F")
    return xyzc(np.moveaxis(a, 0, -1) if a.ndim == 4 else a)


def decode_tiff(b: bytes) -> np.ndarray:
    """Pages of a grey or interleaved TIFF as z; strips plain or deflated."""
    e = {b"II": "<", b"MM": ">"}.get(b[:2])
    if e is None or struct.unpack_from(f"{e}H", b, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    pages, at = [], struct.unpack_from(f"{e}I", b, 4)[0]
    while at:
        tags = {}
        n = struct.unpack_from(f"{e}H", b, at)[0]
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{e}HHI", b, at + 2 + 12 * i)
            form = {1: "B", 3: "H", 4: "I"}.get(kind)
            if form:
                size = struct.calcsize(form) * count
                where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{e}I", b, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(f"{e}{count}{form}", b, where)
        at = struct.unpack_from(f"{e}I", b, at + 2 + 12 * n)[0]
        packing = tags.get(259, (1,))[0]
        strips = [b[o : o + c] for o, c in zip(tags[273], tags[279])]
        if packing in (8, 32946):
            strips = [zlib.decompress(s) for s in strips]
        elif packing != 1:
            raise ValueError(f"TIFF compression {packing} is not supported")
        depth, samples = tags.get(258, (1,))[0], tags.get(277, (1,))[0]
        form = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
        page = np.frombuffer(b"".join(strips), f"{e}{form}{depth // 8}").reshape(tags[257][0], tags[256][0], samples)
        if tags.get(317, (1,))[0] == 2:
            page = np.cumsum(page, axis=1, dtype=page.dtype)
        pages.append(page)
    return np.stack(pages).transpose(2, 1, 0, 3)


def encode_tiff(a: np.ndarray, compress: bool = True) -> bytes:
    """(x, y, z, c) as a TIFF of z pages with interleaved channels."""
    a = xyzc(a)
    form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for z in range(a.shape[2]):
        page = np.ascontiguousarray(a[:, :, z].transpose(1, 0, 2)).astype(a.dtype.newbyteorder("<")).tobytes()
        if compress:
            page = zlib.compress(page, 6)
        data = len(out)
        out += page + bytes(len(out + page) & 1)
        here = len(out)
        struct.pack_into("<I", out, link, here)
        tags = [(256, 4, a.shape[0]), (257, 4, a.shape[1]), (258, 3, a.dtype.itemsize * 8), (259, 3, 8 if compress else 1), (262, 3, 1), (273, 4, data), (277, 3, a.shape[3]), (278, 4, a.shape[1]), (279, 4, len(page)), (339, 3, form)]
        out += struct.pack("<H", len(tags))
        for tag, kind, v in tags:
            out += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", v, 0) if kind == 3 else struct.pack("<I", v))
        link = len(out)
        out += bytes(4)
    return bytes(out)


DECODERS = {".v3draw": decode_v3draw, ".raw": decode_v3draw, ".v3dpbd": decode_v3dpbd, ".npy": decode_npy, ".nrrd": decode_nrrd, ".tif": decode_tiff, ".tiff": decode_tiff}


def decode(path: str, content: bytes) -> np.ndarray:
    """By the extension, or else by the first bytes."""
    f = DECODERS.get(os.path.splitext(path)[1].lower())
    if f is None:
        for key, g in ((RAW_KEY, decode_v3draw), (PBD_KEY, decode_v3dpbd), (b"\x93NUMPY", decode_npy), (b"NRRD", decode_nrrd), (b"II*\0", decode_tiff), (b"MM\0*", decode_tiff)):
            if content.startswith(key):
                f = g
    if f is None:
        raise ValueError(f"unknown kind of image: {path}")
    return f(content)


def row(path: str, a: np.ndarray) -> tuple:
    a = np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<"))
    return path, list(a.shape), a.dtype.str[1:], a.tobytes()


def array(shape, dtype: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<{dtype}").reshape(tuple(shape))


def read_images(spark: SparkSession, path: str, dtype: str | None = "f4", pattern: str | None = None) -> DataFrame:
    """Stacks of a file or of all files under a folder whose name matches ``pattern``; integers scale to 0 .. 1 by default."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    if pattern:
        files = files.where(F.element_at(F.split("path", "/"), -1).rlike(pattern))

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            yield pd.DataFrame([row(p, as_dtype(decode(p, bytes(c)), dtype)) for p, c in zip(pdf.path, pdf.content)], columns=["path", "shape", "dtype", "data"])

    return files.mapInPandas(run, SCHEMA)


def gray(images: DataFrame) -> DataFrame:
    """Stacks with their first channel alone, of shape (x, y, z, 1)."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            yield pd.DataFrame([row(r.path, array(r.shape, r.dtype, bytes(r.data))[..., :1]) for r in pdf.itertuples()], columns=["path", "shape", "dtype", "data"])

    return images.select("path", "shape", "dtype", "data").mapInPandas(run, SCHEMA)


def labelled(images: DataFrame, label: int | Column) -> DataFrame:
    """images with an int label, constant or made from the path."""
    return images.withColumn("label", (F.lit(label) if isinstance(label, int) else label).cast("int"))


def write_tiff(images: DataFrame, folder: str, dtype: str | None = None, compress: bool = True) -> None:
    """Each stack as a TIFF beside the others in ``folder``, which all executors must see."""

    def save(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            name = os.path.splitext(os.path.basename(r["path"]))[0] + ".tif"
            data = encode_tiff(as_dtype(array(r["shape"], r["dtype"], bytes(r["data"])), dtype), compress)
            part = os.path.join(folder, f".{name}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, os.path.join(folder, name))

    images.foreachPartition(save)


# Section: tiled pyramids

_LEVEL = r"RES\(" + "x".join([r"(\d+)"] * 3) + r"\)"


def tile_table(spark: SparkSession, root: str) -> DataFrame:
    """(path, level, ny, nx, nz, y0, x0, z0) of a pyramid's tiles; level 0 is the finest. Offsets are in voxels.

    Folders are RES(YxXxZ)/y/y_x/y_x_z.ext with offsets in tenths of a voxel of the level.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    res = _LEVEL
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    at = lambda i: F.regexp_extract("path", res, i).cast("int")
    off = lambda i: F.floor(F.element_at(F.split(name, "_"), i).cast("double") / 10).cast("int")
    t = f.where(F.col("path").rlike(res) & name.rlike(r"^\d+_\d+_\d+$")).select("path", at(1).alias("ny"), at(2).alias("nx"), at(3).alias("nz"), off(1).alias("y0"), off(2).alias("x0"), off(3).alias("z0"))
    levels = t.select("ny", "nx", "nz").distinct()
    size = lambda p: F.col(f"{p}ny").cast("long") * F.col(f"{p}nx") * F.col(f"{p}nz")
    bigger = levels.alias("a").join(F.broadcast(levels.alias("b")), size("b.") > size("a."), "left").groupBy("a.ny", "a.nx", "a.nz").agg(F.count("b.ny").alias("level"))
    return t.join(F.broadcast(bigger), ["ny", "nx", "nz"]).select("path", F.col("level").cast("int").alias("level"), "ny", "nx", "nz", "y0", "x0", "z0")


def resolutions(tiles: DataFrame) -> DataFrame:
    return tiles.select("level", "ny", "nx", "nz").distinct().orderBy("level")


def tile_at(tiles: DataFrame, points: DataFrame, level: int = 0) -> DataFrame:
    """points (x, y, z, ...) with path of the tile that holds each and its place dx, dy, dz there.

    A point's tile is the last one that starts at or before it, found by the distinct starts of an axis.
    """
    t = tiles.where(F.col("level") == level)
    starts = t.agg(*(F.array_sort(F.collect_set(f"{c}0")).alias(f"_{c}") for c in "xyz"))
    p = points.crossJoin(F.broadcast(starts))  # one row: the starts along each axis

    def last_start(c: str) -> Column:
        return F.array_max(F.filter(F.col(f"_{c}"), lambda v: v <= F.col(c)))

    p = p.withColumns({f"{c}0": last_start(c) for c in "xyz"})
    out = p.join(t.select("path", "x0", "y0", "z0"), ["x0", "y0", "z0"], "left")
    return out.select(*points.columns, "path", *((F.col(c) - F.col(f"{c}0")).alias(f"d{c}") for c in "xyz"))


def patch(spark: SparkSession, tiles: DataFrame, start: tuple[int, int, int], end: tuple[int, int, int], level: int = 0) -> np.ndarray:
    """The box [start, end) in x, y, z of a level (x, y, z, 1); where no tile is, zeros.

    Only tiles that the box meets are read: on each axis from the last one that begins at or before its start.
    """
    (xa, ya, za), (xb, yb, zb) = start, end
    t = tiles.where((F.col("level") == level) & (F.col("x0") < xb) & (F.col("y0") < yb) & (F.col("z0") < zb))
    low = t.agg(*(F.max(F.when(F.col(f"{c}0") <= a, F.col(f"{c}0"))).alias(c) for c, a in zip("xyz", start))).first()
    for c in "xyz":
        t = t.where(F.col(f"{c}0") >= (low[c] or 0))
    files = spark.read.format("binaryFile").load([r["path"] for r in t.select("path").collect()] or [os.devnull]) if not t.isEmpty() else None
    out = np.zeros((xb - xa, yb - ya, zb - za, 1), np.float32)
    if files is None:
        return out
    for r in files.select("path", "content").join(t, "path").toLocalIterator():
        a = as_dtype(decode(r["path"], bytes(r["content"])), "f4")
        lo = [max(s, r[f"{c}0"]) for s, c in zip(start, "xyz")]
        hi = [min(e, r[f"{c}0"] + n) for e, c, n in zip(end, "xyz", a.shape)]
        if all(p < q for p, q in zip(lo, hi)):
            here = tuple(slice(p - s, q - s) for p, q, s in zip(lo, hi, start))
            there = tuple(slice(p - r[f"{c}0"], q - r[f"{c}0"]) for p, q, c in zip(lo, hi, "xyz"))
            out[here] = a[there][..., :1]
    return out
