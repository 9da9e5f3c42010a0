"""A plan of operations over many items of one kind: texts, images or sounds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..media import audio, images, mapped
from ..sources import files
from .pipeline import TextPlan

#: Operations on an image by the name that a plan uses; parameters are passed on.
IMAGE: dict[str, Callable[..., np.ndarray]] = {
    "resize": images.resize, "rotate": images.rotate, "flip": images.flip, "crop": images.crop, "pad": images.pad, "zoom": images.zoom, "normalize": images.standardize,
    "noise": images.gaussian_noise, "brightness": images.brightness, "contrast": images.contrast, "blur": images.gaussian_blur, "median": images.median_filter,
    "edge_detection": images.edges, "canny": images.canny, "equalize": images.equalize, "grayscale": images.grayscale, "hog": images.hog, "glcm": images.glcm, "lbp": images.local_binary_pattern,
}
AUDIO: dict[str, Callable[..., np.ndarray]] = {
    "mfcc": audio.mfcc, "spectrogram": audio.spectrum, "pitch_shift": audio.pitch_shift, "time_stretch": audio.time_stretch, "reverb": audio.reverb, "chorus": audio.chorus,
    "vibrato": audio.modulated, "noise": audio.with_noise, "hum": audio.with_hum, "centroid": audio.centroid, "rolloff": audio.rolloff, "chroma": audio.chroma, "pitch": audio.pitch, "tempo": audio.tempo,
}


class Preprocessor:
    """load() files of one kind, preprocess() them by a plan, get_history() of what was done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.history = spark, []
        self.kind: str | None = None

    def load(self, path: str, kind: str | None = None) -> DataFrame:
        """(path, text), (path, height, width, channels, data) or (path, sample_rate, samples)."""
        self.kind = kind or files.modality(path)
        self.history = [f"load {self.kind}"]
        return {"text": files.read_texts, "image": files.read_images, "audio": files.read_audio}[self.kind](self.spark, path)

    def preprocess(self, df: DataFrame, plan: Sequence[dict], col: str, shape: tuple[int, ...] | None = None, out: str = "out") -> DataFrame:
        """df with the plan's result for col. Images are flat arrays of one shape, which must be given; each operation takes
        the array that the one before gives. An unknown operation raises ValueError before anything runs."""
        if self.kind in (None, "text"):
            self.history += [s["operation"] for s in plan]
            return TextPlan(plan).apply(df, col, out)
        known = IMAGE if self.kind == "image" else AUDIO
        unknown = [s["operation"] for s in plan if s["operation"] not in known]
        if unknown:
            raise ValueError(f"unknown operations {unknown}")
        self.history += [s["operation"] for s in plan]
        steps = [(known[s["operation"]], s.get("params", {})) for s in plan]

        def kernel(x: np.ndarray) -> np.ndarray:
            for f, params in steps:
                x = f(x, **params)
            return x

        return mapped(df, col, kernel, shape, out)

    def get_history(self) -> list[str]:
        return list(self.history)

    def get_metadata(self, df: DataFrame) -> dict:
        return {"kind": self.kind, "columns": dict(df.dtypes)}

    @staticmethod
    def save(df: DataFrame, path: str, columns: Sequence[str]) -> None:
        df.select(*[F.col(c) for c in columns]).write.mode("overwrite").parquet(path)
