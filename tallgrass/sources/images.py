"""Marked regions in pictures of answer sheets: coloured boxes, and what their colours say.

Pictures are arrays of height, width and three channels. Every function takes one picture; ``classify_rasters`` runs
them over a column of raw rasters in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from tallgrass.functions.text import clean_text
from tallgrass.sources.png import read_png, write_png

# Colours, tolerance, sizes in pixels, shares.
GREEN, RED = ((73, 128, 30), (0, 128, 0)), ((152, 8, 20),)
TOLERANCE, GAP, BOX_WIDTH, BOX_HEIGHT, RING, WHOLE_BORDER, TICK_PIXELS, TAIL = 10, 6, 0.70, 18, 6, 0.85, 100, 0.75


def colour_mask(picture: np.ndarray, colours: tuple[tuple[int, int, int], ...], tolerance: int = TOLERANCE) -> np.ndarray:
    """Pixels that are one of the colours, each channel within the tolerance."""
    apart = np.abs(picture.astype(np.int16)[:, :, None, :] - np.array(colours, np.int16))
    return (apart.max(3) <= tolerance).any(2)


def row_clusters(mask: np.ndarray, gap: int = GAP) -> list[tuple[int, int]]:
    """First and last row of each stretch of rows with marks, stretches at most ``gap`` rows apart taken as one."""
    rows = np.flatnonzero(mask.any(1))
    if not len(rows):
        return []
    cuts = np.flatnonzero(np.diff(rows) > gap)
    return list(zip(rows[[0, *(cuts + 1)]].tolist(), rows[[*cuts, len(rows) - 1]].tolist(), strict=True))


def find_boxes(mask: np.ndarray) -> list[tuple[slice, slice]]:
    """Rows and columns of the stretches that are wide and high enough to be a box."""
    out = []
    for top, bottom in row_clusters(mask):
        columns = np.flatnonzero(mask[top : bottom + 1].any(0))
        left, right = int(columns[0]), int(columns[-1])
        if right - left > BOX_WIDTH * mask.shape[1] and bottom - top >= BOX_HEIGHT:
            out.append((slice(top, bottom + 1), slice(left, right + 1)))
    return out


def border_share(mask: np.ndarray, box: tuple[slice, slice], ring: int = RING) -> float:
    """The share of a box's marks that lie within ``ring`` pixels of its outline."""
    own = mask[box]
    inner = own[ring:-ring, ring:-ring].sum() if min(own.shape) > 2 * ring else 0
    return float(1 - inner / own.sum()) if own.any() else 0.0


def classify(picture: np.ndarray) -> str:
    """A wrong answer, one box with or without marks below, several outlines, a filled grid, loose ticks, or no mark."""
    green = colour_mask(picture, GREEN)
    boxes = find_boxes(green)
    if find_boxes(colour_mask(picture, RED)):
        return "RED_WRONG"
    if len(boxes) > 1:
        return "MULTI_ANSWER" if min(border_share(green, b) for b in boxes) >= WHOLE_BORDER else "CROSSWORD"
    if boxes:
        return "GREEN_VERIFIED" if green[int(TAIL * len(green)) :].sum() > TICK_PIXELS else "GREEN_NOCHECK"
    return "GREEN_TICK_ONLY" if green.sum() > TICK_PIXELS else "NO_MARK"


def classify_rasters(pictures: DataFrame) -> DataFrame:
    """``pictures`` (data, height, width: rows of three-byte pixels) with ``cls``; broken sizes give null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, heights, widths in batches:
            yield pd.Series([classify(np.frombuffer(d, np.uint8).reshape(h, w, 3)) if d is not None and len(d) == 3 * h * w > 0 else None for d, h, w in zip(data, heights, widths, strict=True)])

    return pictures.withColumn("cls", run("data", "height", "width"))


#: Classes whose pictures hold answers, and how far a crop lies inside its box.
ANSWERED = ("GREEN_VERIFIED", "GREEN_NOCHECK", "MULTI_ANSWER", "GREEN_TICK_ONLY")
INSET_FIRST, INSET_LAST = 5, 4
_READ = StructType([StructField("cls", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("crops", ArrayType(StructType([StructField("k", StringType()), StructField("png", BinaryType())])))])


def read_answer(data: bytes) -> dict[str, object] | None:
    """A PNG file's class and size, and the PNG files of its answers: a crop for each box, or the whole of a ticked one. None if unreadable."""
    try:
        picture = read_png(data)
    except ValueError:
        return None
    cls, crops = classify(picture), []
    if cls in ANSWERED:
        for k, (rows, columns) in enumerate(find_boxes(colour_mask(picture, GREEN))):
            own = picture[rows.start + INSET_FIRST : rows.stop - 1 - INSET_LAST, columns.start + INSET_FIRST : columns.stop - 1 - INSET_LAST]
            crops.append({"k": str(k), "png": write_png(own)})
        if cls == "GREEN_TICK_ONLY":
            crops.append({"k": "full", "png": write_png(picture)})
    return {"cls": cls, "width": picture.shape[1], "height": picture.shape[0], "crops": crops}


def answer_pictures(blocks: DataFrame, pictures: DataFrame) -> DataFrame:
    """``path i question media cls width height crops`` of every paragraph with a picture, its first one, numbered in order.

    ``blocks`` and ``pictures`` are those of ``read_docx`` and ``read_docx_pictures``. Pictures that can't be read have a null class.
    """

    @F.pandas_udf(_READ)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in batches:
            found = [(read_answer(bytes(d)) if d is not None else None) or dict.fromkeys(_READ.names) for d in files]
            yield pd.DataFrame(found, columns=_READ.names)

    numbered = blocks.filter(F.size("pictures") > 0).select("path", "idx", clean_text("text").alias("question"), F.col("pictures")[0].alias("id"))
    numbered = numbered.withColumn("i", F.row_number().over(Window.partitionBy("path").orderBy("idx")) - 1)
    told = numbered.join(pictures.select("path", "id", F.col("name").alias("media"), "data"), ["path", "id"], "left").withColumn("read", read("data"))
    return told.select("path", "i", "question", "media", "read.*")


def crop_manifest(answers: DataFrame) -> DataFrame:
    """``path i k cls crop question png``: every crop to be transcribed, with the name of its file."""
    rows = answers.select("path", "i", "cls", "question", F.explode("crops").alias("c"))
    number = F.lpad(F.col("i").cast("string"), 3, "0")
    name = F.when(F.col("c.k") == "full", F.concat(F.lit("full"), number)).otherwise(F.concat(F.lit("a"), number, F.lit("_"), F.col("c.k")))
    return rows.select("path", "i", "c.k", "cls", F.concat(name, F.lit(".png")).alias("crop"), "question", "c.png")


def pending_manifest(answers: DataFrame) -> DataFrame:
    """``path i cls media size question`` of the pictures whose answers are to be transcribed."""
    return answers.filter(F.col("cls").isin(*ANSWERED)).select("path", "i", "cls", "media", F.array("width", "height").alias("size"), "question")


def transcription_names(crops: DataFrame) -> DataFrame:
    """``name whole`` of every crop: what its transcription is called, and whether it is a list of questions with answers."""
    return crops.select("path", F.concat_ws("_", "i", "k").alias("name"), (F.col("k") == "full").alias("whole"))
