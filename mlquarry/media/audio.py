"""Signals as arrays with values from -1 to 1."""

from __future__ import annotations

import numpy as np


def sine(frequency: float, duration: float, rate: int = 16000, amplitude: float = 0.5) -> np.ndarray:
    return amplitude * np.sin(2 * np.pi * frequency * np.arange(int(rate * duration)) / rate)


def chirp(start: float, end: float, duration: float, rate: int = 16000) -> np.ndarray:
    f = np.linspace(start, end, int(rate * duration))
    return np.sin(2 * np.pi * np.cumsum(f) / rate)


def white_noise(duration: float, rate: int = 16000, amplitude: float = 0.1, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, amplitude, int(rate * duration))


def resample(x: np.ndarray, old: int, new: int) -> np.ndarray:
    n = int(len(x) * new / old)
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x) if n and len(x) else np.zeros(n)


def frames(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    """Frames of a signal, one at least, filled with zeros."""
    x = np.pad(x, (0, max(0, length - len(x))))
    return np.lib.stride_tricks.sliding_window_view(x, length)[::hop]


def spectrum(x: np.ndarray, n_fft: int = 2048, hop: int = 512) -> np.ndarray:
    """Power of each frame (rows) and frequency, by a Hann window."""
    return np.abs(np.fft.rfft(frames(x, n_fft, hop) * np.hanning(n_fft + 1)[:-1], axis=1)) ** 2


def decibels(power: np.ndarray, ref: float = 1.0) -> np.ndarray:
    return 10 * np.log10(np.maximum(power, 1e-10) / ref)


def mel_filters(n: int, n_fft: int, rate: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    points = 700 * (10 ** (np.linspace(0, top, n + 2) / 2595) - 1)
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    low, mid, high = points[:-2, None], points[1:-1, None], points[2:, None]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))


def mfcc(x: np.ndarray, rate: int = 16000, n_mfcc: int = 13, n_fft: int = 2048, hop: int = 512, n_mels: int = 40) -> np.ndarray:
    """The first cosines of each frame's log mel powers, orthonormal."""
    logs = np.log(spectrum(x, n_fft, hop) @ mel_filters(n_mels, n_fft, rate).T + 1e-9)
    k, i = np.arange(n_mfcc)[:, None], np.arange(n_mels)[None]
    base = np.cos(np.pi * k * (2 * i + 1) / (2 * n_mels)) * np.where(k == 0, np.sqrt(1 / n_mels), np.sqrt(2 / n_mels))
    return logs @ base.T


def delta(features: np.ndarray) -> np.ndarray:
    """Steps between frames, the last repeated."""
    d = np.diff(features, axis=0)
    return np.concatenate([d, d[-1:]]) if len(d) else np.zeros_like(features)


def centroid(x: np.ndarray, rate: int = 16000, n_fft: int = 2048, hop: int = 512) -> np.ndarray:
    p = spectrum(x, n_fft, hop)
    return p @ np.fft.rfftfreq(n_fft, 1 / rate) / (p.sum(axis=1) + 1e-10)


def rolloff(x: np.ndarray, rate: int = 16000, n_fft: int = 2048, hop: int = 512, share: float = 0.85) -> np.ndarray:
    p = spectrum(x, n_fft, hop).cumsum(axis=1)
    return np.fft.rfftfreq(n_fft, 1 / rate)[(p >= share * p[:, -1:]).argmax(axis=1)]


def chroma(x: np.ndarray, rate: int = 16000, n_fft: int = 4096, hop: int = 512) -> np.ndarray:
    """Power of the twelve pitch classes in each frame, as shares; without the constant part."""
    p, f = spectrum(x, n_fft, hop)[:, 1:], np.fft.rfftfreq(n_fft, 1 / rate)[1:]
    at = np.round(12 * np.log2(f / 440.0)).astype(int) % 12
    out = np.stack([p[:, at == k].sum(axis=1) for k in range(12)], axis=1)
    return out / (out.sum(axis=1, keepdims=True) + 1e-10)


def pitch(x: np.ndarray, rate: int = 16000, low: float = 50.0, high: float = 400.0) -> float:
    """The frequency of the strongest period in the range, 0 without one."""
    c = np.correlate(x, x, "full")[len(x) - 1 :] if len(x) else np.zeros(1)
    a, b = int(rate / high), min(int(rate / low), len(c) - 1)
    return rate / (a + int(c[a : b + 1].argmax())) if b > a and c[0] > 0 else 0.0


def onsets(x: np.ndarray, rate: int = 16000, threshold: float = 0.3, n_fft: int = 1024, hop: int = 256) -> np.ndarray:
    """Seconds at which the spectrum rises most, above a share of the largest rise."""
    flux = np.maximum(np.diff(np.sqrt(spectrum(x, n_fft, hop)), axis=0), 0).sum(axis=1)
    flux = flux / (flux.max() + 1e-10) if flux.size else flux
    inner = np.flatnonzero((flux[1:-1] >= threshold) & (flux[1:-1] >= flux[:-2]) & (flux[1:-1] > flux[2:])) + 1 if flux.size > 2 else np.array([], int)
    return (inner + 1) * hop / rate


def tempo(x: np.ndarray, rate: int = 16000, hop: int = 256) -> float:
    """Beats a minute from 40 to 200, 120 if there is no period."""
    e = (frames(x, hop, hop) ** 2).sum(axis=1)
    e = e - e.mean()
    c = np.correlate(e, e, "full")[len(e) - 1 :]
    peaks = np.flatnonzero((c[1:-1] > c[:-2]) & (c[1:-1] >= c[2:])) + 1 if len(c) > 2 else np.array([], int)
    return float(np.clip(60 * rate / (hop * peaks[0]), 40, 200)) if peaks.size else 120.0


def time_stretch(x: np.ndarray, speed: float) -> np.ndarray:
    return resample(x, 1000, int(1000 / speed))


def pitch_shift(x: np.ndarray, semitones: float) -> np.ndarray:
    y = time_stretch(x, 2 ** (semitones / 12))
    return np.interp(np.linspace(0, len(y) - 1, len(x)), np.arange(len(y)), y) if len(y) else x


def reverb(x: np.ndarray, rate: int = 16000, room: float = 0.5, damp: float = 0.5) -> np.ndarray:
    """Four combs of different delays, added to the signal."""
    out = np.zeros(len(x))
    for ms in (29.7, 37.1, 41.1, 43.7):
        d, y = max(1, int(rate * ms / 1000)), x.astype(float).copy()
        for a in range(d, len(x), d):  # a delay at a time: within it nothing feeds back
            n = min(d, len(x) - a)
            y[a : a + n] += room * (1 - damp / 2) * y[a - d : a - d + n]
        out += y
    return x + (out / 4 - x) * 0.5


def modulated(x: np.ndarray, rate: int = 16000, speed: float = 5.0, depth: float = 0.002) -> np.ndarray:
    """Vibrato: the signal read at a swinging delay."""
    at = np.arange(len(x)) - depth * rate * (1 + np.sin(2 * np.pi * speed * np.arange(len(x)) / rate)) / 2
    return np.interp(at, np.arange(len(x)), x, left=0.0) if len(x) else x


def chorus(x: np.ndarray, rate: int = 16000, speed: float = 1.5, depth: float = 0.002) -> np.ndarray:
    return (x + modulated(x, rate, speed, depth)) / 2


def with_noise(x: np.ndarray, factor: float = 0.005, seed: int = 0) -> np.ndarray:
    return x + factor * np.random.default_rng(seed).normal(size=len(x))


def with_hum(x: np.ndarray, rate: int = 16000, frequency: float = 50.0, size: float = 0.01) -> np.ndarray:
    return x + size * np.sin(2 * np.pi * frequency * np.arange(len(x)) / rate)
