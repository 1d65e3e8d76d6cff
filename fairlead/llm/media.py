"""Media columns: texts stored losslessly as baseline JPEG files, read back, with thumbnails and their hashes.

A row's bytes are padded with spaces to a positive multiple of 192 and stored as an image's quantised coefficients
(see `jpeg`). What is reported comes from the stored file: its markers are parsed, its scan decoded, the payload and
the DC-only luminance thumbnail reconstructed. One narrow stage; batches hold a bounded number of bytes beside the
longest single text.

Defined results: a null or empty text is stored as 192 spaces; equal texts give equal files and features, repeated rows
a row each; a null id is carried through; thumbnail cells that tie with the mean are 0 bits; a very long text is one
image, coded lane by lane in a batch of its own; an empty table gives an empty result; other
columns are not read, so their names may clash with ours.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import jpeg

#: Bytes of payload coded together.
BATCH_BYTES = 3_000_000
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def padded(raw: bytes) -> bytes:
    """With spaces up to a positive multiple of the unit."""
    return raw.ljust(max(1, -(-len(raw) // jpeg.UNIT)) * jpeg.UNIT, b" ")


def thumbnail_hash(light: np.ndarray) -> str:
    """Average hash over an 8 x 8 grid of cells, and the CRC-32 of the whole thumbnail."""
    rows = np.add.reduceat(light.astype(np.int64), _edges(light.shape[0]), 0)
    cells = np.add.reduceat(rows, _edges(light.shape[1]), 1)
    bits = (cells * cells.size > cells.sum()).ravel()
    return f"{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}-{zlib.crc32(light.tobytes()):08x}"


def _edges(n: int) -> np.ndarray:
    return np.arange(8) * n // 8 if n >= 8 else np.arange(n)


def stored(raws: list[bytes]) -> Iterator[tuple[bytes, jpeg.Image]]:
    """The file of each text's bytes, and the image read from it."""
    files = jpeg.encode([padded(r) for r in raws])
    return zip(files, jpeg.decode(files), strict=True)


def _describe(raws: list[bytes], with_file: bool) -> list[tuple]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = []
    for raw, (blob, image) in zip(raws, stored(raws), strict=True):
        payload, light = image.payload(), image.thumbnail()
        row = (
            len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]), len(blob), sha(blob),
            f"{image.width}x{image.height}-{thumbnail_hash(light)}",
        )
        rows.append((*row, blob, light.tobytes()) if with_file else row)
    return rows


def media_columns(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_file: bool = False, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, ... feature) for every row; with_file adds `media` and `thumbnail`, both binary."""
    schema = SCHEMA + (", media binary, thumbnail binary" if with_file else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in in_batches(batches, batch_bytes):
            columns = zip(*_describe(raws, with_file), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(list(c), _kind(n)) for c, n in zip(columns, names[1:], strict=True))], names
            )

    return skinny(docs, id_col, text_col).mapInArrow(code, schema)


def _kind(name: str) -> pa.DataType:
    return pa.binary() if name in ("media", "thumbnail") else pa.string() if name.endswith("sha256") or name == "feature" else pa.int64()


def skinny(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw): the id and the text's UTF-8 bytes."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("raw"))


def in_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and bytes of rows, in groups of about `most` bytes."""
    ids, raws, size = [], [], 0
    for batch in batches:
        for i, raw in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            raws.append(raw.as_py())
            size += len(raws[-1])
            if size >= most:
                yield ids, raws
                ids, raws, size = [], [], 0
    if ids:
        yield ids, raws


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored form of every document holds."""
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_media_columns": op3_media_columns}
ORACLES: dict[str, str] = {}
