"""Where recognition and model replies come from.  A provider is called once per partition with filtered rows only.

Providers must be idempotent: Spark may call them again for a lost task.  ``TableProvider`` serves stored evidence, so runs work
without any engine; ``EngineProvider`` runs a command-line recogniser over side images and a command-line model over prompts.
"""

import os
import shutil
import struct
import subprocess
import tempfile
import time
import zlib
from collections.abc import Callable, Iterator
from itertools import batched
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FALLBACK_PASSES, LINE_PASSES, LINES_AT_ONCE, SIDES_AT_ONCE, WHOLE_PASSES, Pass
from ..operators.lines import words_to_lines, words_to_readings
from ..schemas import EVIDENCE
from ..sources import images as pictures
from ..sources.tsv import parse_words
from .stages import stage


def pass_table(spark, passes: tuple[Pass, ...]) -> DataFrame:
    """The passes in their declared order."""
    return spark.createDataFrame([(p.name, p.language, p.psm, p.scale, p.transform, i) for i, p in enumerate(passes)], "name string, language string, psm int, scale double, transform string, pass_order int")


class TableProvider:
    """Evidence, line readings and replies read from tables; each method gets the rows that are asked for."""

    def __init__(self, whole: DataFrame, fallback: DataFrame | None = None, lines: DataFrame | None = None, replies: DataFrame | None = None):
        self.whole, self.fallback, self.lines, self.replies = whole, fallback, lines, replies

    def read_sides(self, sides: DataFrame, side: list[str]) -> DataFrame:
        return self.whole.join(sides.select(*side).distinct(), side, "left_semi")

    def read_fallback(self, sides: DataFrame, side: list[str]) -> DataFrame:
        source = self.fallback if self.fallback is not None else self.whole.limit(0)
        return source.join(sides.select(*side).distinct(), side, "left_semi")

    def read_lines(self, lines: DataFrame) -> DataFrame:
        if self.lines is None:
            return lines.sparkSession.createDataFrame([], "line_id string, source string, pass_order int, text string, conf double")
        return self.lines.join(lines.select("line_id").distinct(), "line_id", "left_semi")

    def reply(self, prompts: DataFrame) -> DataFrame:
        if self.replies is None:
            return prompts.select("book", "batch_no", F.lit('{"items":[]}').alias("reply"))
        return prompts.select("book", "batch_no").join(self.replies, ["book", "batch_no"], "left").select("book", "batch_no", "reply")


def find_program(explicit: str | None, variable: str, names: tuple[str, ...]) -> str:
    """The first that exists: the given path, the one an environment variable names, or a program on the path."""
    for candidate in (explicit, os.environ.get(variable), *(shutil.which(n) for n in names)):
        if candidate and Path(candidate).exists():
            return candidate
    raise FileNotFoundError(f"none of {', '.join(names)} was found; set {variable}")


def require_languages(available: set[str], needed: frozenset[str] = frozenset({"vie", "eng"})) -> None:
    if missing := sorted(needed - available):
        raise RuntimeError(f"missing languages: {', '.join(missing)}")


def installed_languages(program: str, timeout: int = 30) -> set[str]:
    """Languages that a recogniser lists after its headline."""
    said = subprocess.run([program, "--list-langs"], capture_output=True, text=True, timeout=timeout, check=True).stdout
    return {line.strip() for line in said.splitlines()[1:] if line.strip()}


def png(image: np.ndarray) -> bytes:
    """A gray image as an uncompressed-quality PNG file."""
    height, width = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def recognise(program: str, drawn: list[np.ndarray], one: Pass, timeout: int, threads: int) -> list[str]:
    """One call of the engine over a list of images; the TSV of each image, header included."""
    with tempfile.TemporaryDirectory() as folder:  # a task's own scratch
        names = []
        for at, image in enumerate(drawn):
            names.append(f"{folder}/{at:03d}.png")
            Path(names[-1]).write_bytes(png(image))
        listing = Path(folder, "images.txt")
        listing.write_text("\n".join(names), encoding="utf-8")
        options = ["-l", one.language, "--oem", "1", "--psm", str(one.psm), "-c", "preserve_interword_spaces=1", "tsv"]
        done = subprocess.run([program, str(listing), "stdout", *options], capture_output=True, text=True, encoding="utf-8", errors="replace", timeout=timeout, env=os.environ | {"OMP_THREAD_LIMIT": str(threads)})
    if done.returncode:
        raise RuntimeError(f"recognition by {one.name} failed: {done.stderr.strip()}")
    head, _, body = done.stdout.partition("\n")
    place = head.split("\t").index("page_num")
    parts = [[head] for _ in drawn]
    for line in body.splitlines():
        cells = line.split("\t")
        number = cells[place] if len(cells) > place else ""
        at = max(0, int(number or "1") - 1) if number.isdigit() or not number else len(parts)
        if line and at < len(parts):
            parts[at].append(line)
    return ["\n".join(p) for p in parts]


_LOCKED = "is locked"


def ask(command: list[str], prompt: str, timeout: int, waits: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0)) -> str:
    """What a command says to a prompt.  ``{prompt}`` in the command is a file with the prompt, ``{folder}`` the call's own folder.

    A call that failed because another holds the program's session store is repeated; each call has a store of its own.
    """
    for wait in (*waits, None):
        with tempfile.TemporaryDirectory() as folder:  # a task's own scratch
            written = Path(folder, "prompt.txt")
            written.write_text(prompt, encoding="utf-8", newline="\n")
            words = [x.replace("{prompt}", str(written)).replace("{folder}", folder) for x in command]
            alone = {"NO_COLOR": "1", "FORCE_COLOR": "0", "PYTHONUTF8": "1", "OPENCODE_DB": f"{folder}/session.db"}
            done = subprocess.run(words, cwd=folder, capture_output=True, text=True, encoding="utf-8", errors="replace", timeout=timeout, env=os.environ | alone)
        said = f"{done.stdout}\n{done.stderr}"
        if not done.returncode:
            return said
        if wait is None or _LOCKED not in said.lower():
            raise RuntimeError(f"the model's program failed ({done.returncode}): {said[:2000]}")
        time.sleep(wait)
    raise AssertionError


def model_command(program: str, model: str | None) -> list[str]:
    """The call of a model's program with a prompt file."""
    return [program, "run", *(["--model", model] if model else []), "--dir", "{folder}", "The attached file holds the whole task. Answer with the JSON it asks for.", "--file", "{prompt}"]


class EngineProvider:
    """Recognises side images ``(book, page, side, height, width, channels, pixels)`` and asks a model about lines.

    A task holds the images of one call at a time.  Sides and lines meet their images by key; an image's lines are one row, so
    its pixels are sent once however many lines are read again.
    """

    def __init__(self, images: DataFrame, program: str, sides_at_once: int = SIDES_AT_ONCE, lines_at_once: int = LINES_AT_ONCE, workers: int | None = None, timeout: int = 180, threads: int = 1, command: list[str] | None = None, reply_timeout: int = 120):
        self.images, self.program, self.sides_at_once, self.lines_at_once, self.workers = images, program, sides_at_once, lines_at_once, workers
        self.timeout, self.threads, self.command, self.reply_timeout = timeout, threads, command, reply_timeout

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """As many calls at once as workers, each with sides of its own."""
        n = self.workers or rows.sparkSession.sparkContext.defaultParallelism
        return rows.repartition(n, "book", "page", "side").sortWithinPartitions("book", "page", "side")

    def _reader(self) -> Callable[[list[np.ndarray], Pass], list[str]]:
        program, timeout, threads = self.program, self.timeout, self.threads
        return lambda drawn, one: recognise(program, drawn, one, timeout, threads)

    def _sides(self, sides: DataFrame, side: list[str], passes: tuple[Pass, ...], first: int, at_once: int) -> DataFrame:
        read = self._reader()
        wanted = self._dealt(self.images.join(sides.select(*side).distinct(), side, "left_semi")).select(*side, "height", "width", "channels", "pixels")

        def run(batches):
            import pandas as pd

            for group in batched(_rows(batches), at_once):
                drawn = [pictures.to_array(r.pixels, r.height, r.width, r.channels) for r in group]
                for nth, one in enumerate(passes):
                    said = read([pictures.prepare(image, one.transform, one.scale) for image in drawn], one)
                    yield pd.DataFrame([(r.book, r.page, r.side, one.name, first + nth, one.scale, tsv) for r, tsv in zip(group, said, strict=True)], columns=["book", "page", "side", "source", "pass_order", "scale", "tsv"])

        texts = wanted.mapInPandas(run, "book string, page int, side string, source string, pass_order int, scale double, tsv string")
        keys = [*side, "source", "pass_order", "scale"]
        return words_to_lines(parse_words(texts, keys), keys, F.col("scale")).select(*[c.split()[0] for c in EVIDENCE.split(", ")])

    def read_sides(self, sides: DataFrame, side: list[str]) -> DataFrame:
        return self._sides(sides, side, WHOLE_PASSES, 0, self.sides_at_once)

    def read_fallback(self, sides: DataFrame, side: list[str]) -> DataFrame:
        return self._sides(sides, side, FALLBACK_PASSES, len(WHOLE_PASSES), 1)

    def read_lines(self, lines: DataFrame) -> DataFrame:
        read, at_once, side = self._reader(), self.lines_at_once, ["book", "page", "side"]
        boxes = lines.groupBy(*side).agg(F.sort_array(F.collect_list(F.struct("line_id", "x", "y", "w", "h"))).alias("boxes"))
        wanted = self._dealt(self.images.join(boxes, side)).select(*side, "height", "width", "channels", "pixels", "boxes")

        def crops(batches):
            for r in _rows(batches):
                image = pictures.to_array(r.pixels, r.height, r.width, r.channels)
                for box in r.boxes:
                    yield box["line_id"], pictures.crop(image, box["x"], box["y"], box["w"], box["h"]).copy()

        def run(batches):
            import pandas as pd

            for group in batched(crops(batches), at_once):
                for nth, one in enumerate(LINE_PASSES):
                    said = read([pictures.prepare(image, one.transform, one.scale) for _, image in group], one)
                    yield pd.DataFrame([(key, one.name, nth, tsv) for (key, _), tsv in zip(group, said, strict=True)], columns=["line_id", "source", "pass_order", "tsv"])

        texts = wanted.mapInPandas(run, "line_id string, source string, pass_order int, tsv string")
        key = ["line_id", "source", "pass_order"]
        texts = stage(texts)  # read twice below
        read_again = words_to_readings(parse_words(texts, key), key)
        # a crop in which nothing was read is an empty reading
        nothing = texts.select(*key, F.lit("").alias("text"), F.lit(0.0).alias("conf"))
        return read_again.unionByName(nothing).groupBy(*key).agg(F.max_by(F.struct("text", "conf"), F.length("text")).alias("r")).select(*key, "r.text", "r.conf")

    def reply(self, prompts: DataFrame) -> DataFrame:
        """What the model says to each prompt; a call that fails for good gives no reply, and the run stops."""
        if not self.command:
            raise FileNotFoundError("no program that answers prompts was given")
        command, timeout = self.command, self.reply_timeout

        def answer(prompt: str) -> str | None:
            try:
                return ask(command, prompt, timeout)
            except (OSError, RuntimeError, subprocess.SubprocessError):
                return None

        return prompts.select("book", "batch_no", F.udf(answer, "string", useArrow=True)("prompt").alias("reply"))


def _rows(batches) -> Iterator:
    """Rows of pandas batches, one at a time."""
    for frame in batches:
        yield from frame.itertuples(index=False)
