"""Pictures of matches: both images side by side, lines between matched points, names above and the decision below, as PNG files.

A figure is a row; drawing is work of the tasks.  Files go through a data source
of its own: tasks write beside the results, and only the commit of the whole job
moves them to <root>/<modality>/<gt>/<name>.png, so a job that failed, or a task
that ran twice, leaves nothing there.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .images import PNG

#: Letters of 3 x 5 dots, row by row; what isn't here is a box.
LETTERS = {
    "0": "111101101101111", "1": "010110010010111", "2": "111001111100111", "3": "111001111001111", "4": "101101111001001", "5": "111100111001111", "6": "111100111101111", "7": "111001010010010", "8": "111101111101111", "9": "111101111001111",
    "A": "010101111101101", "B": "110101110101110", "C": "011100100100011", "D": "110101101101110", "E": "111100110100111", "F": "111100110100100", "G": "011100101101011", "H": "101101111101101", "I": "111010010010111", "J": "001001001101010", "K": "101101110101101", "L": "100100100100111", "M": "101111111101101",
    "N": "110101101101101", "O": "010101101101010", "P": "110101110100100", "Q": "010101101111011", "R": "110101110101101", "S": "011100010001110", "T": "111010010010010", "U": "101101101101111", "V": "101101101101010", "W": "101101111111101", "X": "101101010101101", "Y": "101101010010010", "Z": "111001010100111",
    " ": "000000000000000", ".": "000000000000010", "-": "000000111000000", "_": "000000000000111", ":": "000010000010000", "/": "001001010100100", "=": "000111000111000", "%": "101001010100101",
}
BOX = "111101101101111"
GREEN, RED, CYAN, YELLOW = (0, 255, 0), (255, 0, 0), (0, 255, 255), (255, 255, 0)
COLOURS = {"inlier": GREEN, "outlier": RED, "match": CYAN}
LIGHT, DARK, BAND = 230, 30, 24


def encode_png(image: np.ndarray) -> bytes:
    """Height x width x 3, 8 bits."""
    h, w = image.shape[:2]
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.astype(np.uint8).reshape(h, -1)], axis=1)
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def lines(image: np.ndarray, ends: np.ndarray, colours: np.ndarray, share: float = 1.0) -> None:
    """Segments (x1, y1, x2, y2), all at once: a pixel for each step along the longer side; later ones lie above."""
    with np.errstate(invalid="ignore"):
        sound = np.isfinite(ends).all(axis=1) & (np.abs(ends).max(axis=1, initial=0) < 1e6)
    ends, colours = ends[sound], colours[sound]
    if not len(ends):
        return
    a, b = ends[:, :2], ends[:, 2:]
    steps = np.maximum(1, np.ceil(np.abs(b - a).max(axis=1))).astype(int)
    of = np.repeat(np.arange(len(ends)), steps + 1)
    way = (np.arange(len(of)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)) / steps[of]
    x, y = np.rint(a[of] + (b - a)[of] * way[:, None]).astype(int).T
    on = (x >= 0) & (x < image.shape[1]) & (y >= 0) & (y < image.shape[0])
    image[y[on], x[on]] = (1 - share) * image[y[on], x[on]] + share * colours[of[on]]


def points(image: np.ndarray, at: np.ndarray, colour: tuple[int, int, int], radius: float = 3.0) -> None:
    """A ring around each point, drawn as short segments."""
    turn = np.linspace(0, 2 * np.pi, 13)
    ring = radius * np.column_stack([np.cos(turn), np.sin(turn)])
    start, end = ring[:-1], ring[1:]
    segments = np.concatenate([(at[:, None] + start).reshape(-1, 2), (at[:, None] + end).reshape(-1, 2)], axis=1)
    lines(image, segments, np.tile(np.array(colour, float), (len(segments), 1)))


def text(image: np.ndarray, words: str, x: int, y: int, colour: tuple[int, int, int], size: int = 2) -> None:
    """Dots of ``size`` pixels from (x, y) on; what goes beyond the image is left out."""
    dots = [(k * 4 + c, r) for k, letter in enumerate(words.upper()) for r in range(5) for c in range(3) if LETTERS.get(letter, BOX)[3 * r + c] == "1"]
    for dx, dy in dots:
        image[max(0, y + dy * size) : max(0, y + (dy + 1) * size), max(0, x + dx * size) : max(0, x + (dx + 1) * size)] = colour


def width_of(words: str, size: int = 2) -> int:
    return max(0, 4 * len(words) - 1) * size


def _colour(values: list | None, w: int | None, h: int | None, channels: int | None) -> np.ndarray:
    if not values or not w or not h:
        return np.zeros((1, 1, 3))
    return np.repeat(np.reshape(values, (h, w, -1)), 3 // (channels or 1), axis=2)


def drawn(first: np.ndarray, second: np.ndarray, segments: list[dict], names: tuple[str, str], below: str, right: bool | None, least_width: int) -> np.ndarray:
    """One picture; segments have x1, y1, x2, y2 in each image's own pixels, a kind, and perhaps a confidence."""
    h, gap = max(first.shape[0], second.shape[0]), first.shape[1]
    both = np.zeros((h, gap + second.shape[1], 3))
    both[: first.shape[0], :gap], both[: second.shape[0], gap:] = first, second
    if segments:
        ends = np.array([[s["x1"], s["y1"], s["x2"] + gap, s["y2"]] for s in segments], float)
        sure = np.array([1.0 if s.get("confidence") is None else min(1.0, max(0.0, s["confidence"])) for s in segments])
        colours = np.array([COLOURS.get(s["kind"], CYAN) for s in segments], float)
        plain = np.array([s["kind"] not in ("inlier", "outlier") for s in segments])
        colours[plain] = colours[plain] * sure[plain, None] + np.array(RED) * (1 - sure[plain, None])  # less sure, more red
        order = np.argsort(np.array([s["kind"] == "inlier" for s in segments]), kind="stable")  # inliers lie above
        lines(both, ends[order], colours[order])
        for at in (ends[:, :2], ends[:, 2:]):
            points(both, at[np.isfinite(at).all(axis=1)], YELLOW)
    w = max(least_width, both.shape[1])
    out = np.zeros((h + 2 * BAND, w, 3))
    out[:BAND], out[BAND + h :] = LIGHT, DARK
    left = (w - both.shape[1]) // 2
    out[BAND : BAND + h, left : left + both.shape[1]] = both
    for k, name in enumerate(names):
        text(out[:BAND], name, 5 + k * w // 2, 7, (0, 0, 0))
    text(out[BAND + h :], below, max(0, (w - width_of(below)) // 2), 7, (255, 255, 255) if right is None else GREEN if right else RED)
    return np.rint(out).astype(np.uint8)


SEGMENTS = "array<struct<x1:double,y1:double,x2:double,y2:double,kind:string,confidence:double>>"
FIGURES = "pair_id string, modality string, gt boolean, name string, content binary"


def figures(pairs: DataFrame, images: DataFrame, segments: DataFrame, least_width: int = 320) -> DataFrame:
    """(pair_id, modality, gt, name, content) of pairs (pair_id, modality, gt, file1, file2, same): a PNG picture of each.

    images: as ``sources.images`` gives them; segments: (pair_id, x1, y1, x2,
    y2, kind[, confidence]), each end in its own image's pixels.  Pairs without
    segments are pictures without lines, an unread image is one black pixel, and
    a pair without a decision says so.
    """
    sure = F.col("confidence") if "confidence" in segments.columns else F.lit(None)
    line = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], F.coalesce("kind", F.lit("match")).alias("kind"), sure.cast("double").alias("confidence"))
    own = segments.groupBy(F.col("pair_id").alias("segment_pair")).agg(F.array_sort(F.collect_list(line)).cast(SEGMENTS).alias("segments"))
    picture = lambda n: images.select(F.col("path").alias(f"file{n}"), F.struct("values", "width", "height", "channels").alias(f"image{n}"))
    t = pairs.join(own, pairs["pair_id"] == own["segment_pair"], "left").join(picture(1), "file1", "left").join(picture(2), "file2", "left")
    t = t.select(F.col("pair_id").cast("string").alias("pair_id"), "modality", "gt", "same", "file1", "file2", "image1", "image2", "segments")
    schema = pa.schema([("pair_id", pa.string()), ("modality", pa.string()), ("gt", pa.bool_()), ("name", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                one, two = (_colour(*((r[c] or {}).get(k) for k in ("values", "width", "height", "channels"))) for c in ("image1", "image2"))
                names = tuple((r[c] or "none").rsplit("/", 1)[-1] for c in ("file1", "file2"))
                below = f"SAME: {'UNKNOWN' if r['same'] is None else 'YES' if r['same'] else 'NO'}"
                content = encode_png(drawn(one, two, r["segments"] or [], names, below, None if r["same"] is None or r["gt"] is None else r["same"] == r["gt"], least_width))
                stem = "_vs_".join(re.sub(r"[^\w.-]", "_", re.sub(r"\.[A-Za-z0-9]+$", "", n)) for n in names)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((r["pair_id"], r["modality"], r["gt"], stem, content), schema, strict=True)], schema=schema)

    return t.mapInArrow(run, FIGURES)


# files


@dataclass
class Written(WriterCommitMessage):
    """Where a task's files are, and where they belong."""

    moves: list[tuple[str, str]]


def _safe(part) -> str:
    return re.sub(r"[^\w.-]", "_", "none" if part is None else str(part)).lstrip(".") or "none"


class FileWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        from ..streaming.camera import _system

        self.root, self.overwrite, self.work = root.rstrip("/"), overwrite, f"_temporary-{uuid.uuid4().hex}"
        self.system = _system

    def write(self, iterator) -> Written:
        system, root = self.system(self.root)
        task, moves, taken = uuid.uuid4().hex, [], set()
        system.create_dir(f"{root}/{self.work}/{task}", recursive=True)
        for n, r in enumerate(iterator):
            kind = "same" if r["gt"] else "different" if r["gt"] is not None else "none"
            to = f"{_safe(r['modality'])}/{kind}/{_safe(r['name'])}"
            if to in taken:
                to += f"-{_safe(r['pair_id'])}"
            taken.add(to)
            at = f"{self.work}/{task}/{n}.png"
            with system.open_output_stream(f"{root}/{at}") as f:
                f.write(bytes(r["content"]))
            moves.append((at, f"{to}.png"))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        """Every task is done: its files go to their places; names that several tasks have get a number."""
        system, root = self.system(self.root)
        taken: dict[str, int] = {}
        for at, to in (m for message in messages if message for m in message.moves):
            k = taken[to] = taken.get(to, 0) + 1
            place = f"{root}/{to if k == 1 else f'{to[:-4]}-{k}.png'}"
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            system.move(f"{root}/{at}", place)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = self.system(self.root)
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.work}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.work}")


class FigureSink(DataSource):
    """``df.write.format("figures").mode("append").save(root)`` of rows as ``figures`` gives them; register it first."""

    @classmethod
    def name(cls) -> str:
        return "figures"

    def schema(self) -> str:
        return FIGURES

    def writer(self, schema, overwrite: bool) -> FileWriter:
        path = dict(self.options).get("path")
        if not path:
            raise ValueError("figures need a path")
        return FileWriter(path, overwrite)
