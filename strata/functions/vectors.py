"""Vectors in storage, the model-free encoder, image preprocessing and strict JSON, on Arrow batches."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.lexical import tokens


def pack_half(vector: Column) -> Column:
    """Little-endian half floats; null for a vector with a value that is not finite or beyond 1.002."""

    def run(values: pd.Series) -> pd.Series:
        def one(v: np.ndarray | None) -> bytes | None:
            x = None if v is None else np.asarray(v, np.float64)
            return None if x is None or not np.isfinite(x).all() or (np.abs(x) > 1.002).any() else x.astype("<f2").tobytes()

        return values.map(one)

    return F.pandas_udf(run, "binary")(vector)


def unpack_half(packed: Column) -> Column:
    """Unit vectors from half floats: rounding is undone as far as the length goes."""

    def run(values: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> list[float] | None:
            if b is None:
                return None
            x = np.frombuffer(b, "<f2").astype(np.float32)
            return (x / max(float(np.linalg.norm(x)), 1e-12)).tolist()

        return values.map(one)

    return F.pandas_udf(run, "array<float>")(packed)


def hashing_encoder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder for where no model is: signed token hashes, normalised."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts):
            for t in tokens(text):
                h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
                row[h % size] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encoded(text: Column, encode: Callable[[list[str]], np.ndarray], batch: int = 16) -> Column:
    """Unit vectors by any encoder, in batches; null texts have none."""

    def run(values: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        known = values.dropna()
        for a in range(0, len(known), batch):
            part = known.iloc[a : a + batch]
            out.loc[part.index] = pd.Series([v.tolist() for v in encode(part.tolist())], index=part.index)
        return out

    return F.pandas_udf(run, "array<float>")(text)


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the states that the mask keeps, of length 1."""
    total = (states * mask[..., None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9)
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)


def resized(image: np.ndarray, edge: int, size: int, mean: tuple[float, ...], std: tuple[float, ...]) -> np.ndarray:
    """Channels-first floats of an RGB or RGBA image: transparency on white, shortest edge to ``edge`` by
    bilinear interpolation, the middle ``size`` square, normalised."""
    x = image.astype(np.float64)
    if x.shape[2] == 4:
        alpha = x[..., 3:] / 255
        x = x[..., :3] * alpha + 255 * (1 - alpha)
    h, w = x.shape[:2]
    scale = edge / min(h, w)
    for axis, (old, new) in enumerate(((h, max(size, round(h * scale))), (w, max(size, round(w * scale))))):
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, old - 1)
        part = (at - low).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        x = np.take(x, low, axis) * (1 - part) + np.take(x, high, axis) * part
    top, left = (x.shape[0] - size) // 2, (x.shape[1] - size) // 2
    x = np.rint(x[top : top + size, left : left + size]) / 255
    return ((x - np.array(mean)) / np.array(std)).transpose(2, 0, 1).astype(np.float32)


def difference_hash(gray: np.ndarray) -> int:
    """64 bits of an 8 by 9 gray image: whether each value is above the one to its right."""
    bits = (gray[:, :-1] > gray[:, 1:]).ravel()
    return int("".join("1" if b else "0" for b in bits), 2)


def strict_json(text: Column, keys: tuple[str, ...]) -> Column:
    """Whether a text is an object with exactly these keys, none twice and none null."""

    def run(values: pd.Series) -> pd.Series:
        def one(raw: str | None) -> bool:
            seen: list[list[str]] = []

            def pairs(found: list[tuple[str, object]]) -> dict:
                seen.append([k for k, _ in found])
                return dict(found)

            try:
                x = json.loads(raw or "", object_pairs_hook=pairs)
            except ValueError:
                return False
            return isinstance(x, dict) and set(x) == set(keys) and None not in x.values() and all(len(s) == len(set(s)) for s in seen)

        return values.map(one)

    return F.pandas_udf(run, "boolean")(text)


def framed(value: object) -> bytes:
    """An unambiguous binary form of a JSON value: kind, length and content, numbers as their IEEE 754 bits."""
    if value is None or isinstance(value, bool):
        return {None: b"n", True: b"t", False: b"f"}[value]
    if isinstance(value, int | float):
        return b"d" + struct.pack(">d", float(value) + 0.0)
    if isinstance(value, str):
        raw = value.encode()
        return b"s" + struct.pack(">Q", len(raw)) + raw
    if isinstance(value, list):
        return b"a" + struct.pack(">Q", len(value)) + b"".join(map(framed, value))
    return b"o" + struct.pack(">Q", len(value)) + b"".join(framed(k) + framed(v) for k, v in sorted(value.items()))
