"""Files of text, images and sound as DataFrames, through Spark's own readers; encoders back to bytes."""

from __future__ import annotations

import io
import re
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODALITIES = {"txt": "text", "csv": "text", "json": "text", "ppm": "image", "pgm": "image", "bmp": "image", "wav": "audio", "pcm": "audio"}


def modality(path: str) -> str:
    """text, image or audio by the ending; ValueError for others."""
    end = path.rpartition(".")[2].lower()
    if end not in MODALITIES:
        raise ValueError(f"unknown ending {end!r}")
    return MODALITIES[end]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def decode_image(data: bytes) -> np.ndarray:
    """P2, P3, P5, P6 and uncompressed BMP of 8 or 24 bits, as height * width or height * width * 3."""
    if data[:2] == b"BM":
        start, (w, h), bits = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<ii", data, 18), struct.unpack_from("<H", data, 28)[0]
        if bits not in (8, 24) or struct.unpack_from("<I", data, 30)[0]:
            raise ValueError("only uncompressed BMP of 8 or 24 bits")
        n = bits // 8
        stride = (w * n + 3) // 4 * 4
        rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * n].reshape(abs(h), w, n)
        rows = rows[::-1] if h > 0 else rows
        return rows[..., ::-1].copy() if n == 3 else rows[..., 0].copy()
    if data[:2] not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("no image that is known here")
    at, numbers = 2, []
    while len(numbers) < 3:
        found = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not found:
            raise ValueError("the image's header is cut")
        numbers.append(int(found[1]))
        at = found.end()
    w, h, _ = numbers
    c = 3 if data[1:2] in b"36" else 1
    if data[1:2] in b"56":
        values = np.frombuffer(data, np.uint8, w * h * c, at + 1)
    else:
        values = np.array(data[at:].split()[: w * h * c], int).astype(np.uint8)
    return values.reshape((h, w, 3) if c == 3 else (h, w)).copy()


def encode_image(x: np.ndarray, binary: bool = True) -> bytes:
    """PGM or PPM; values are cut to 0..255."""
    x = np.clip(x, 0, 255).astype(np.uint8)
    kind = {(True, 2): "P5", (True, 3): "P6", (False, 2): "P2", (False, 3): "P3"}[binary, x.ndim]
    head = f"{kind}\n{x.shape[1]} {x.shape[0]}\n255\n".encode()
    return head + (x.tobytes() if binary else " ".join(map(str, x.reshape(-1).tolist())).encode() + b"\n")


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples from -1 to 1, of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as file:
        rate, channels, width = file.getframerate(), file.getnchannels(), file.getsampwidth()
        raw = file.readframes(file.getnframes())
    return rate, decode_pcm(raw, channels, width)


def decode_pcm(raw: bytes, channels: int = 1, width: int = 2) -> np.ndarray:
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(axis=1)


def encode_wav(x: np.ndarray, rate: int = 16000) -> bytes:
    """Mono of 16 bits, brought to a peak of 1 if above."""
    peak = np.abs(x).max() if len(x) else 0.0
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(np.round(x / max(peak, 1.0) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _decoded(files: DataFrame, schema: str, decode) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, values = decode(data)
                yield pa.RecordBatch.from_arrays([pa.array([path]), *values], names=["path", *names])

    return files.select("path", "content").mapInArrow(kernel, schema)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data): pixels row by row."""

    def decode(data: bytes):
        x = decode_image(data)
        c = x.shape[2] if x.ndim == 3 else 1
        return ["height", "width", "channels", "data"], [pa.array([v], pa.int32()) for v in (*x.shape[:2], c)] + [pa.array([x.reshape(-1).astype(float)], pa.list_(pa.float64()))]

    return _decoded(spark.read.format("binaryFile").load(path), "path string, height int, width int, channels int, data array<double>", decode)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, samples)."""

    def decode(data: bytes):
        rate, x = decode_wav(data)
        return ["sample_rate", "samples"], [pa.array([rate], pa.int32()), pa.array([x], pa.list_(pa.float64()))]

    return _decoded(spark.read.format("binaryFile").load(path), "path string, sample_rate int, samples array<double>", decode)


def image_grid(spark: SparkSession, height: int, width: int, kind: str = "blank", color: float = 0.0, seed: int = 0) -> DataFrame:
    """(y, x, v) of a synthetic image: blank, horizontal, vertical, gaussian or uniform."""
    rows = spark.range(height * width).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    values = {
        "blank": F.lit(float(color)),
        "horizontal": F.col("x") * (255.0 / max(1, width - 1)),
        "vertical": F.col("y") * (255.0 / max(1, height - 1)),
        "gaussian": F.greatest(F.least(128 + 30 * F.randn(seed), F.lit(255.0)), F.lit(0.0)),
        "uniform": 255 * F.rand(seed),
    }
    if kind not in values:
        raise ValueError(f"unknown image {kind!r}")
    return rows.withColumn("v", values[kind])


def parameters_json(parameters: list[tuple[str, np.ndarray]]) -> str:
    """Names, shapes and values of a model's parameters as JSON."""
    import json

    return json.dumps({"format": "layers", "layers": [{"name": n, "shape": list(p.shape), "dtype": str(p.dtype), "data": p.reshape(-1).tolist()} for n, p in parameters]})
