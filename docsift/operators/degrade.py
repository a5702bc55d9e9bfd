"""A set of degraded images: some of the degradations for each image, drawn by a seeded hash, applied, and written as files with their metadata."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.experiments import sample_variants
from docsift.operators.extraction import netpbm
from docsift.operators.images import DEGRADATIONS
from docsift.sources.imagefiles import image_metadata, write_image_files

KERNELS_DDL = "stem string, degradation string, height int, width int, channels int, data binary, error string"


def degraded(images: DataFrame, k: int = 5, variants: list[str] | None = None, seed: int = 42) -> DataFrame:
    """(stem, degradation, height, width, channels, data, error) of images (stem, height, width, channels, data): k degradations of each, and the image itself as original. One pass, no shuffle; each
    kernel's own chance is seeded by image and degradation, so a task that runs again makes the same image. What fails keeps its error."""
    drawn = sample_variants(images.select("stem", "height", "width", "channels", "data"), list(variants or DEGRADATIONS), k, "stem", seed=seed)
    drawn = drawn.withColumn("seed", F.pmod(F.xxhash64(F.lit(seed), "stem", "degradation"), F.lit(1 << 31)))

    def run(batches):
        import numpy as np

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    shape = (row["height"], row["width"]) if row["channels"] == 1 else (row["height"], row["width"], row["channels"])
                    x = np.ascontiguousarray(DEGRADATIONS[row["degradation"]](np.frombuffer(row["data"], np.uint8).reshape(shape), row["seed"]))
                    out.append((row["stem"], row["degradation"], x.shape[0], x.shape[1], 1 if x.ndim == 2 else x.shape[2], x.tobytes(), None))
                except Exception as e:  # noqa: BLE001
                    out.append((row["stem"], row["degradation"], row["height"], row["width"], row["channels"], None, str(e)))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["stem", "degradation", "height", "width", "channels", "data", "error"])

    made = drawn.mapInArrow(run, KERNELS_DDL)
    itself = images.select("stem", F.lit("original").alias("degradation"), "height", "width", "channels", "data", F.when(F.col("data").isNull(), "no image").alias("error"))
    return made.unionByName(itself)


def generate(images: DataFrame, path: str, k: int = 5, variants: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Writes the set below path, a folder for each degradation, and gives its metadata (original, degradation, output, bytes). Images that fail are left out."""
    rows = degraded(images, k, variants, seed).where("error is null").withColumn("id", F.struct("stem", "degradation"))
    files = netpbm(rows, "id").select(F.col("doc_id.stem").alias("stem"), F.col("doc_id.degradation").alias("degradation"), F.col("image").alias("content"))
    name = F.concat("stem", F.lit(".pnm"))
    write_image_files(files.select(name.alias("original"), "degradation", name.alias("file"), "content"), path)
    return image_metadata(images.sparkSession, path)
