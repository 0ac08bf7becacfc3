"""Pixels: splitting spreads, trimming margins, preparing images for a pass; numpy inside Arrow batches."""

import numpy as np
from pyspark.sql import DataFrame

from ..schemas import SIDE_IMAGE


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image; a gray image is copied."""
    if image.ndim == 2:
        return image.copy()
    weights = np.array([0.114, 0.587, 0.299])
    return np.clip(np.rint(image[:, :, :3] @ weights), 0, 255).astype(np.uint8)


def _kernel(sigma: float, reach: int) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return k / k.sum()


def blur(image: np.ndarray, sigma: float, reach: int, mode: str = "reflect") -> np.ndarray:
    """Separable Gaussian blur."""
    out, kernel = image.astype(float), _kernel(sigma, reach)
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(out, pad, mode=mode if out.shape[axis] > reach else "edge")
        out = sum(w * np.take(wide, range(i, i + out.shape[axis]), axis=axis) for i, w in enumerate(kernel))
    return out


def sharpen(image: np.ndarray) -> np.ndarray:
    g = gray(image).astype(float)
    return np.clip(np.rint(1.65 * g - 0.65 * np.rint(blur(g, 1.0, 4))), 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> np.ndarray:
    """Black and white at the level that parts the histogram best."""
    g = gray(image)
    counts = np.bincount(g.ravel(), minlength=256).astype(float)
    low, levels = counts.cumsum(), np.arange(256)
    mass = (counts * levels).cumsum()
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(low * high * (mass / low - (mass[-1] - mass) / high) ** 2)
    return np.where(g > int(np.argmax(between)), 255, 0).astype(np.uint8)


def adaptive(image: np.ndarray, block: int = 41, offset: int = 15) -> np.ndarray:
    """Black where a pixel is darker than its Gaussian neighbourhood by more than ``offset``."""
    g = gray(image)
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    return np.where(g > np.rint(blur(g, sigma, block // 2, "edge")) - offset, 255, 0).astype(np.uint8)


def resize(image: np.ndarray, scale: float) -> np.ndarray:
    """Bicubic resampling with edges repeated."""
    out = image.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        places = (np.arange(max(1, round(n * scale))) + 0.5) / scale - 0.5
        base = np.floor(places).astype(int)
        total = np.zeros((*out.shape[:axis], len(places), *out.shape[axis + 1 :]))
        for step in range(-1, 3):
            d = np.abs(places - (base + step))
            a = -0.75
            w = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0.0))
            shape = [1] * out.ndim
            shape[axis] = len(places)
            total += np.take(out, np.clip(base + step, 0, n - 1), axis=axis) * w.reshape(shape)
        out = total
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


TRANSFORMS = {"gray": gray, "sharp": sharpen, "otsu": otsu, "adaptive": adaptive}


def prepare(image: np.ndarray, transform: str, scale: float) -> np.ndarray:
    return resize(TRANSFORMS[transform](image), scale)


def trim(image: np.ndarray, white: int = 247) -> np.ndarray:
    """Without nearly white margins but with a little padding; a blank image stays as it is."""
    dark = gray(image) < white
    rows, columns = np.flatnonzero(dark.any(1)), np.flatnonzero(dark.any(0))
    if not len(rows):
        return image
    height, width = dark.shape
    pad_y, pad_x = max(8, int(height * 0.012)), max(8, int(width * 0.015))
    return image[max(0, rows[0] - pad_y) : min(height, rows[-1] + pad_y + 1), max(0, columns[0] - pad_x) : min(width, columns[-1] + pad_x + 1)]


def halves(image: np.ndarray, gutter_share: float = 0.012) -> tuple[np.ndarray, np.ndarray]:
    """Left and right page of a spread, cut at the middle without a thin gutter, trimmed."""
    width = image.shape[1]
    middle, gutter = width // 2, max(4, int(width * gutter_share))
    return trim(image[:, : max(1, middle - gutter)]), trim(image[:, min(width - 1, middle + gutter) :])


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A line's box with padding, inside the image."""
    height, width = image.shape[:2]
    pad_x, pad_y = max(25, int(width * 0.06)), max(22, int(height * 0.025))
    return image[max(0, y - pad_y) : min(height, y + h + pad_y), max(0, x - pad_x) : min(width, x + w + pad_x)]


def to_array(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    image = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    return image[:, :, 0] if channels == 1 else image


def split_spreads(spreads: DataFrame) -> DataFrame:
    """Spreads ``(page, height, width, channels, pixels)`` to side images, two for each page."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for page, height, width, channels, pixels in zip(frame["page"], frame["height"], frame["width"], frame["channels"], frame["pixels"], strict=True):
                for side, half in zip("LR", halves(to_array(pixels, height, width, channels)), strict=True):
                    out.append((page, side, half.shape[0], half.shape[1], 1 if half.ndim == 2 else half.shape[2], np.ascontiguousarray(half).tobytes()))
            yield pd.DataFrame(out, columns=["page", "side", "height", "width", "channels", "pixels"])

    return spreads.select("page", "height", "width", "channels", "pixels").mapInPandas(run, SIDE_IMAGE)


def check_range(start: int, end: int, pages: int) -> None:
    """Pages are counted from 1, both ends included."""
    if start < 1 or end > pages or start > end:
        raise ValueError(f"pages {start} to {end} are not within 1 to {pages}")
