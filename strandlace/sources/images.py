"""Image sinks: PNG, SVG, binary ``.dot`` files and parameter files.  Images are bounded by their size in pixels."""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.ridges import each_image, images_of


class SizeError(ValueError):
    """Pixels don't fill the stated width and height, or exceed a limit."""


def densify(pixels: DataFrame, width: int, height: int, limit: int = 1 << 29) -> np.ndarray:
    """Sparse ``px, py, value`` rows of one plot as a ``height x width`` array; refused beyond ``limit`` bytes."""
    if width * height > limit:
        raise SizeError(f"{width} x {height} pixels exceed {limit} bytes")
    out = np.zeros((height, width), np.uint8)
    for px, py, value in pixels.select("px", "py", "value").toLocalIterator():
        out[py, px] = value
    return out


def png(image: np.ndarray, invert: bool = False, text: dict[str, str] | None = None) -> bytes:
    """An 8-bit grey PNG with text chunks."""
    if image.ndim != 2:
        raise SizeError("a grey image has two dimensions")
    rows = np.ascontiguousarray(255 - image if invert else image, np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate((np.zeros((rows.shape[0], 1), np.uint8), rows), axis=1).tobytes()
    notes = b"".join(chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1", "replace")) for k, v in (text or {}).items())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 0, 0, 0, 0)) + notes + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """Pixels and text chunks of a PNG that ``png`` wrote."""
    at, idat, notes, size = 8, b"", {}, (0, 0)
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            idat += body
        elif kind == b"tEXt":
            k, _, v = body.partition(b"\0")
            notes[k.decode("latin-1")] = v.decode("latin-1")
        at += n + 12
    rows = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(size[1], size[0] + 1)
    return rows[:, 1:].copy(), notes


def svg(image: np.ndarray, x_label: str, y_label: str, x_ticks: list[tuple[int, str]] = (), y_ticks: list[tuple[int, str]] = (), meta: str = "", elements: str | None = None, margin: int = 40) -> str:
    """An SVG with the PNG embedded, a frame, ticks and labels; ``elements`` stand for the ticks (those of ``plans.axes``, drawn for the same margin)."""
    h, w = image.shape
    data, edge = base64.b64encode(png(image)).decode(), margin + 20
    if elements is None:
        marks = [f'<path d="M{margin + x} {margin}v-6" stroke="black"/><text x="{margin + x}" y="{margin - 10}" font-size="9" text-anchor="middle">{escape(t)}</text>' for x, t in x_ticks]
        marks += [f'<path d="M{margin} {margin + y}h-6" stroke="black"/><text x="{margin - 10}" y="{margin + 3 + y}" font-size="9" text-anchor="end">{escape(t)}</text>' for y, t in y_ticks]
        elements = "".join(marks)
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{w + edge}" height="{h + edge}"><metadata>{escape(meta)}</metadata>'
        f'<image x="{margin}" y="{margin}" width="{w}" height="{h}" href="data:image/png;base64,{data}"/><rect x="{margin}" y="{margin}" width="{w}" height="{h}" fill="none" stroke="black"/>'
        + elements
        + f'<text x="{margin + w // 2}" y="14" font-size="11" text-anchor="middle">{escape(x_label)}</text><text x="12" y="{margin + h // 2}" font-size="11">{escape(y_label)}</text></svg>'
    )


def image_files(pixels: DataFrame, sizes: DataFrame, key: list[str], encode) -> DataFrame:
    """``key, data``: one encoded image for each plot (``sizes`` has ``key, width, height``); ``encode`` turns an array into bytes.  A plot is one task's work, bounded by its size."""

    def run(batches):
        for own, image in each_image(batches, len(key)):
            yield pa.RecordBatch.from_arrays([*own, pa.array([encode(image)], pa.binary())], names=[*key, "data"])

    kinds = dict(sizes.dtypes)
    return images_of(pixels, sizes, key).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", data binary")


#: Columns of ``image_file``.
IMAGE_FILES = {"data": "binary"}


def image_file(encode):
    """A drawing of whole plots for ``block_images``: ``data``, the encoded image, as ``image_files`` has it of pixels that are already scored."""
    return lambda image, _: [pa.array([encode(image)], pa.binary())]


def image_pixels(files: DataFrame, key: list[str], decode) -> DataFrame:
    """``key, px, py, value``: the lit pixels of encoded images; ``decode`` turns bytes into an array."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                image = decode(b.column(len(key))[i].as_py())
                py, px = np.nonzero(image)
                at = pa.array(np.full(len(px), i))
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(len(key))), pa.array(px), pa.array(py), pa.array(image[py, px].astype(np.int64))], names=[*key, "px", "py", "value"])

    kinds = dict(files.dtypes)
    return files.select(*key, "data").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", px long, py long, value long")


@dataclass
class DotFile:
    """A plot as a binary file: little-endian, format 1 to 3.

    Format 1 has no parameters; format 3 keeps the zoom as a double.
    """

    zoom: float
    image: np.ndarray
    pixel_factor: int = 50
    window: int = 25
    matrix_name: str = "UNKNOWN"
    matrix: np.ndarray = field(default_factory=lambda: np.zeros((24, 24), np.int32))

    def to_bytes(self) -> bytes:
        name = self.matrix_name.encode()[:256]
        full = np.zeros((24, 24), "<i4")
        full[: self.matrix.shape[0], : self.matrix.shape[1]] = self.matrix
        h, w = self.image.shape
        return struct.pack("<Bdii", 3, self.zoom, w, h) + struct.pack("<iii", self.pixel_factor, self.window, len(name)) + name + full.tobytes() + np.ascontiguousarray(self.image, np.uint8).tobytes()


def read_dot(data: bytes) -> DotFile:
    """Parse a ``.dot`` file of any of the three formats."""
    version = data[0]
    if version not in (1, 2, 3):
        raise ValueError(f"unknown format {version}")
    head = "<Bdii" if version == 3 else "<Biii"
    _, zoom, w, h = struct.unpack_from(head, data)
    at, out = struct.calcsize(head), DotFile(0, np.zeros((0, 0), np.uint8))
    if version > 1:
        out.pixel_factor, out.window, n = struct.unpack_from("<iii", data, at)
        if not 0 <= n <= 256:
            raise ValueError("matrix name too long")
        at += 12
        out.matrix_name = data[at : at + n].decode("utf-8", "replace")
        at += n
        out.matrix = np.frombuffer(data, "<i4", 576, at).reshape(24, 24).copy()
        at += 576 * 4
    if len(data) - at < w * h:
        raise SizeError("pixels are cut short")
    out.zoom, out.image = float(zoom), np.frombuffer(data, np.uint8, w * h, at).reshape(h, w).copy()
    return out


def params_toml(sections: dict[str, dict]) -> str:
    """A parameter file: sections of plain values."""

    def value(x) -> str:
        if isinstance(x, bool):
            return str(x).lower()
        return repr(x) if isinstance(x, int | float) else '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"'

    return "\n".join(f"[{name}]\n" + "".join(f"{k} = {value(v)}\n" for k, v in body.items() if v is not None) for name, body in sections.items())


def input_record(data: bytes, path: str) -> dict:
    return {"path": path, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
