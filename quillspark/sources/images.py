"""Images of papers. Decoders are optional: without one, every image is skipped with the usual message.

Rows are ``path, content``; results have Spark's image layout (height, width, channels, data).
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIZE = 896


def _margins(length: int, size: int) -> tuple[int, int]:
    """White before and after ``length`` of ``size``; the odd pixel goes behind."""
    white = size - length
    return white // 2, white - white // 2


def fit_to_square(image: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The whole image, its longer side as long as the square (up too), white around; bicubic where a library is there."""
    rows, columns = (max(1, round(n * size / max(image.shape[:2]))) for n in image.shape[:2])
    try:
        import cv2

        fitted = cv2.resize(image, (columns, rows), interpolation=cv2.INTER_CUBIC)
    except ImportError:  # the nearest pixel
        picked = (np.arange(new) * old // new for new, old in ((rows, image.shape[0]), (columns, image.shape[1])))
        fitted = image[np.ix_(*picked)]
    return np.pad(fitted, (_margins(rows, size), _margins(columns, size), (0, 0)), constant_values=255)


def _first_page(content: bytes, size: int) -> bytes | None:
    tool = shutil.which("pdftoppm")
    if tool is None:
        return None
    with tempfile.TemporaryDirectory() as d:
        pdf = Path(d, "in.pdf")
        pdf.write_bytes(content)
        done = subprocess.run([tool, "-f", "1", "-singlefile", "-scale-to", str(size), "-png", pdf, Path(d, "out")], capture_output=True, check=False)
        page = Path(d, "out.png")
        return page.read_bytes() if done.returncode == 0 and page.exists() else None


def decode(name: str, content: bytes, size: int = SIZE) -> np.ndarray | None:
    """RGB pixels, or None if the image can't be read here."""
    raw = _first_page(content, size) if name.lower().endswith(".pdf") else content
    if raw is None:
        return None
    try:
        import cv2
    except ImportError:
        return None
    image = cv2.imdecode(np.frombuffer(raw, np.uint8), cv2.IMREAD_COLOR)
    return None if image is None else image[:, :, ::-1]


def checked(images: np.ndarray | list[np.ndarray] | None) -> np.ndarray | None:
    """A batch ``[n, height, width, 3]`` of uint8 pixels, from one image or several; None for none."""
    if images is None or len(images) == 0:
        return None
    batch = np.stack(images) if isinstance(images, list) else images
    batch = batch[None] if batch.ndim == 3 else batch
    if batch.ndim != 4 or batch.shape[-1] != 3 or batch.dtype != np.uint8:
        raise ValueError(f"images must be uint8 with shape height, width, 3; got {batch.dtype} {batch.shape}")
    return batch


def load(files: DataFrame, size: int = SIZE) -> DataFrame:
    """``path, height, width, channels, data, skipped`` for rows ``path, content``; skipped: the message, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1]
                image = decode(name, content or b"", size) if content else None
                data = None if image is None else fit_to_square(image, size).tobytes()
                n = None if data is None else size
                message = None if data else f"{name}: image could not be rendered or read"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int32()), pa.array([n], pa.int32()), pa.array([data and 3], pa.int32()), pa.array([data], pa.binary()), pa.array([message], pa.string())], ["path", "height", "width", "channels", "data", "skipped"])

    return files.select("path", "content").mapInArrow(run, "path string, height int, width int, channels int, data binary, skipped string")
