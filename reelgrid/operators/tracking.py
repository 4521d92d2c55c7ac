"""Faces: greedy tracks, which are sequential inside a shot, and clusters."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.operators.proximity import near_components


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union else 0.0


def track_faces(faces: DataFrame, by: list[str], least_iou: float = 0.5, max_gap: int = 10, least_frames: int = 10, least_size: float = 1.0) -> DataFrame:
    """Tracks of faces: by, track_id, frame, x1, y1, x2, y2, face_id (null where interpolated).

    The earliest face left seeds a track; faces in order of frame join it if
    they overlap its last box by more than ``least_iou``, until none comes
    within ``max_gap`` frames. Tracks of more than ``least_frames`` faces and a
    mean width or height above ``least_size`` stay, gaps filled linearly. Of
    the boxes in one frame the first that fits is taken; no face is skipped.
    """
    keys = ", ".join(f"{c} {faces.schema[c].dataType.simpleString()}" for c in by)

    def run(key, pdf):
        rows = pdf.sort_values(["frame", "face_id"])[["frame", "face_id", "x1", "y1", "x2", "y2"]].values.tolist()
        out = []
        while rows:
            track, rest = [], []
            for i, r in enumerate(rows):
                if not track:
                    track.append(r)
                elif r[0] - track[-1][0] > max_gap:
                    rest += rows[i:]
                    break
                elif r[0] > track[-1][0] and _iou(r[2:], track[-1][2:]) > least_iou:
                    track.append(r)
                else:
                    rest.append(r)
            rows = rest
            if len(track) <= least_frames:
                continue
            at = np.array([r[0] for r in track])
            full = np.arange(at[0], at[-1] + 1)
            box = [np.interp(full, at, [r[2 + i] for r in track]) for i in range(4)]
            if max((box[2] - box[0]).mean(), (box[3] - box[1]).mean()) <= least_size:
                continue
            ids = {int(r[0]): r[1] for r in track}
            name = hashlib.sha256(f"{key}|{track[0][1]}".encode()).hexdigest()[:32]
            out.append(pd.DataFrame({**{c: k for c, k in zip(by, key, strict=True)}, "track_id": name, "frame": full, "x1": box[0], "y1": box[1], "x2": box[2], "y2": box[3], "face_id": [ids.get(int(f)) for f in full]}))
        cols = [*by, "track_id", "frame", "x1", "y1", "x2", "y2", "face_id"]
        return pd.concat(out)[cols] if out else pd.DataFrame(columns=cols)

    return faces.groupBy(*by).applyInPandas(run, f"{keys}, track_id string, frame long, x1 double, y1 double, x2 double, y2 double, face_id string")


def cluster_vectors(vectors: DataFrame, by: str, item: str, vec: str, eps: float = 0.5) -> DataFrame:
    """(by, item, cluster): density clusters of cosine distance ``eps`` and two points at least; -1 for points alone.

    With two points a cluster is a connected component of the near pairs
    (``linked_within``); no task holds a key's vectors or all pairs. Clusters are
    numbered in each key by their first item. Items are unique in their key.
    """
    names = near_components(vectors, by, item, vec, eps)
    first = names.groupBy(by, "name").agg(F.min(item).alias("_first"))
    numbered = first.select(by, "name", (F.row_number().over(Window.partitionBy(by).orderBy("_first")) - 1).alias("_n"))
    found = names.join(numbered, [by, "name"]).select(by, item, "_n")
    return vectors.select(by, item).join(found, [by, item], "left").select(by, item, F.coalesce("_n", F.lit(-1)).cast("int").alias("cluster"))


def cluster_reduced(vectors: DataFrame, by: str, item: str, vec: str, eps: float = 0.5, keep_variance: float = 0.95) -> DataFrame:
    """(by, item, cluster) as ``cluster_vectors`` gives them, over the principal axes of a key that hold ``keep_variance``.

    Vectors are scaled to length one before and after. One task holds a
    video's vectors, and compares them in blocks.
    """
    keys = f"{by} {vectors.schema[by].dataType.simpleString()}, {item} {vectors.schema[item].dataType.simpleString()}, cluster int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, ignore_index=True)
        x = np.array(pdf[vec].tolist(), np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        if len(x) > 1:
            centred = x - x.mean(axis=0)
            _, s, axes = np.linalg.svd(centred, full_matrices=False)
            n = int(np.searchsorted(np.cumsum(s**2) / max(1e-12, (s**2).sum()), keep_variance)) + 1
            x = centred @ axes[:n].T
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        root = list(range(len(x)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a in range(0, len(x), 512):
            for i, j in np.argwhere(1 - x[a : a + 512] @ x.T <= eps).tolist():
                if a + i < j:
                    p, q = find(a + i), find(j)
                    root[max(p, q)] = min(p, q)
        found = [find(i) for i in range(len(x))]
        sizes = np.bincount(found, minlength=len(x))
        number = {r: k for k, r in enumerate(sorted({r for r in found if sizes[r] > 1}))}
        return pd.DataFrame({by: pdf[by], item: pdf[item], "cluster": [number.get(r, -1) for r in found]})

    return vectors.select(by, item, vec).groupBy(by).applyInPandas(run, keys)
