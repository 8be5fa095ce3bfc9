"""Feature extraction of images with label maps: arrays and single files at once, folders of them by Spark."""

from __future__ import annotations

import argparse
import csv
import io
import os
import traceback
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stainloom.operators import batch, nucleus
from stainloom.operators import features as feats
from stainloom.operators.regions import PADDING
from stainloom.operators.stain import Normaliser, normalise
from stainloom.sources import files, mat, png

# Fixed values of the interface.
IMAGE_EXTS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")
METADATA_COLS = ("Tissue", "Sex", "Age Bracket", "Hardy Scale", "Pathology Categories")
METADATA_KEY = "Tissue Sample ID"
TYPE_KEY = "inst_type"
ID_SOURCES = ("first_dir", "parent_dir", "stem")
FOLDERS = ("pre_normalized_nuclei", "post_normalized_nuclei")


@dataclass(frozen=True)
class ImageResult:
    ok: bool
    image_path: str
    mat_path: str | None
    mat_key: str | None
    nuclei: int
    warnings: tuple[str, ...] = ()
    error: str | None = None
    traceback: str | None = None


@dataclass(frozen=True)
class BatchResult:
    tasks_discovered: int
    completed_images: int
    failed_images: int
    total_nuclei: int
    warnings: list[str]
    results: list[ImageResult]


def check_gpu() -> bool:
    """Kernels run on CPUs only."""
    return False


def get_gpu_device_count() -> int:
    return 0


def _no_gpu(use_gpu: bool | None) -> None:
    if use_gpu:
        raise RuntimeError("no GPU is available")


def _image(image) -> np.ndarray:
    image = np.asarray(image)
    if image.ndim != 3 or image.shape[2] != 3 or not image.size:
        raise ValueError("an image has rows, columns and three channels")
    return image.astype(np.uint8, copy=False)


def normalize_staining(image) -> np.ndarray:
    return normalise(_image(image))


def _normalised(image: np.ndarray) -> np.ndarray:
    """The image in reference stains, or as it is where that fails."""
    try:
        return normalise(image)
    except ValueError:
        return image


def _masks(masks, shape: tuple[int, int]) -> list[tuple[int, np.ndarray]]:
    """(id, mask) of a label map or of a list of masks, in order; ids of a list are places from 1."""
    if isinstance(masks, (list, tuple)):
        out = [(i, np.asarray(m)) for i, m in enumerate(masks, 1)]
        if any(m.dtype != bool for _, m in out):
            raise TypeError("a list of masks holds boolean arrays")
    else:
        masks = np.asarray(masks)
        if masks.ndim != 2 or masks.dtype.kind not in "ui":
            raise TypeError("masks are a map of whole-number labels or a list of boolean arrays")
        if masks.shape != shape or not masks.size:
            raise ValueError(f"image of {shape} and labels of {masks.shape}")
        return [(label, masks == label) for label in np.unique(masks).tolist() if label]
    for _, m in out:
        if m.shape != shape:
            raise ValueError(f"image of {shape} and mask of {m.shape}")
        if not m.any():
            raise RuntimeError("a mask is empty")
    return out


def _box(mask: np.ndarray, padding: int) -> tuple[tuple[int, int, int, int], tuple[slice, slice]]:
    """Inclusive bounding box of a mask, and its padded patch."""
    r, c = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    box = (int(r[0]), int(c[0]), int(r[-1]), int(c[-1]))
    return box, (slice(max(box[0] - padding, 0), box[2] + padding + 1), slice(max(box[1] - padding, 0), box[3] + padding + 1))


def extract_features(
    image, masks, use_gpu: bool | None = None, *, save_crops: bool = False, crop_output_dir: str | Path | None = None, padding: int = PADDING,
    save_pre_normalized_crops: bool = True, save_post_normalized_crops: bool = True, normalize: bool = False, families=feats.FAMILIES,
) -> list[dict[str, float]]:
    """A dictionary of features for each nucleus of one image, in order of ids.

    ``masks`` is a map of labels (0 is background) or a list of boolean masks, which may overlap.
    ``padding`` is that of the crops; features always take the fixed one. Without ``normalize`` the
    columns after normalisation are those before.
    """
    _no_gpu(use_gpu)
    if save_crops and crop_output_dir is None:
        raise ValueError("crop_output_dir is required when save_crops=True")
    image = _image(image)
    found = _masks(masks, image.shape[:2])
    other = _normalised(image) if normalize else image
    names, rows, middles = feats.columns(families), [], []
    of_pixels = [f for f in nucleus.OF_PIXELS if f in families]
    for ident, mask in found:
        _, at = _box(mask, PADDING)
        m = mask[at]
        r, c = np.nonzero(mask)
        middles.append((r.mean(), c.mean()))
        before = nucleus.of_pixels(image[at], m, of_pixels)
        after = before if other is image else nucleus.of_pixels(other[at], m, of_pixels)
        rows.append([float(ident), *nucleus.of_mask(m, (at[0].start, at[1].start), families), *before, *after])
    near = feats.nearest(np.array(middles).reshape(-1, 2))
    if save_crops:
        save_crops_of(image, found, crop_output_dir, padding, save_pre_normalized_crops, save_post_normalized_crops)
    clean = lambda x: float(x) if np.isfinite(x) else 0.0
    return [dict(zip(names, map(clean, [*row, d]), strict=True)) for row, d in zip(rows, near, strict=True)]


def save_crops_of(image: np.ndarray, found: list[tuple[int, np.ndarray]], out: str | Path, padding: int = PADDING, pre: bool = True, post: bool = True) -> list[dict]:
    """Masked crops as PNG files; a record of each nucleus with its box and paths."""
    other = _normalised(image) if post else None
    records = []
    for ident, mask in found:
        box, at = _box(mask, padding)
        paths = []
        for folder, of in zip(FOLDERS, (image if pre else None, other), strict=True):
            path = Path(out) / folder / f"nucleus_{ident:04d}.png" if of is not None else None
            if path is not None:
                write_whole(path, png.encode(np.where(mask[at][..., None], of[at], 0)))
            paths.append(None if path is None else str(path))
        records.append({"nucleus_id": ident, "bbox": box, "pre_path": paths[0], "post_path": paths[1]})
    return records


def write_whole(path: Path, data: bytes) -> None:
    """A file that is there whole or not at all, also when a task is run twice."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}")
    part.write_bytes(data)
    os.replace(part, path)


def _load(image_path, mat_path, mat_key: str | None):
    path = Path(image_path).expanduser()
    if path.suffix.lower() == ".png":
        image = png.decode(path.read_bytes())
    else:
        row = files.read_images(SparkSession.builder.getOrCreate(), str(path)).first()
        if row is None or row["rgb"] is None:
            raise ValueError(f"cannot read {path}")
        image = feats.array_of(row["rgb"], "u1", row["height"], row["width"], 3)
    return image, mat.choose(mat.parse(Path(mat_path).expanduser().read_bytes()), mat_key)[1]


def extract_features_from_files(image_path, mat_path, *, mat_key: str | None = None, use_gpu: bool | None = None, **kwargs) -> list[dict[str, float]]:
    """As extract_features() of an image file and a MAT file."""
    image, labels = _load(image_path, mat_path, mat_key)
    return extract_features(image, labels, use_gpu, **kwargs)


def save_cropped_nuclei_from_files(image_path, mat_path, output_dir, *, mat_key: str | None = None, padding: int = PADDING, save_pre_normalized: bool = True, save_post_normalized: bool = True) -> list[dict]:
    """Crops of an image file by a MAT file; see save_crops_of()."""
    image, labels = _load(image_path, mat_path, mat_key)
    return save_crops_of(image, _masks(labels, image.shape[:2]), output_dir, padding, save_pre_normalized, save_post_normalized)


def csv_of(rows: list[dict], metadata: Sequence[str]) -> bytes:
    """A table of one image: id, metadata, type, then features in their order, then other columns by name."""
    names = ["nucleus_id", *metadata, "nucleus_type", *feats.columns()[1:]]
    names += sorted({k for r in rows for k in r} - set(names))
    out = io.StringIO()
    w = csv.DictWriter(out, names, restval="")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue().encode()


class BatchExtractor:
    """Features, tables and crops of all images below a folder that have a MAT file of the same relative path.

    An image is a row: it is read by Spark from any store, computed in one task, and its table and
    crops are written by that task below the output folders, which all executors have to share. What
    goes wrong with an image is its result and does not end the job.
    """

    def __init__(
        self, image_root, mat_root, output_csv_root, output_nuclei_root, *, image_exts: Sequence[str] = IMAGE_EXTS, recursive: bool = True, workers: int | None = None, max_images: int | None = None,
        skip_existing: bool = False, mat_key: str | None = None, inst_type_key: str = TYPE_KEY, padding: int = PADDING, use_gpu: bool = False, stain_normalization_features: bool = True, metadata_csv=None,
        metadata_key_column: str = METADATA_KEY, metadata_cols: Sequence[str] = METADATA_COLS, metadata_id_source: str = "first_dir", spark: SparkSession | None = None,
    ):
        self.image_root, self.mat_root = str(image_root), str(mat_root)
        self.output_csv_root, self.output_nuclei_root = Path(output_csv_root).expanduser().resolve(), Path(output_nuclei_root).expanduser().resolve()
        if metadata_id_source not in ID_SOURCES:
            raise ValueError(f"metadata_id_source is one of {', '.join(ID_SOURCES)}")
        self.image_exts, self.recursive, self.workers, self.max_images, self.skip_existing = tuple(image_exts), recursive, workers, max_images, skip_existing
        self.mat_key, self.inst_type_key, self.padding, self.use_gpu, self.stain = mat_key, inst_type_key, padding, use_gpu, stain_normalization_features
        self.metadata_csv, self.metadata_key_column, self.metadata_cols, self.metadata_id_source = metadata_csv, metadata_key_column, tuple(metadata_cols), metadata_id_source
        self.spark = spark or SparkSession.builder.getOrCreate()

    def _listed(self, root: str, exts: Sequence[str]) -> DataFrame:
        """rel and path of the files below a folder, without their contents."""
        root = os.path.expanduser(root)
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", self.recursive).option("pathGlobFilter", files.by_suffix(exts)).load(root).select("path")
        return self._related(found, root, "rel").select("rel", "path")

    @staticmethod
    def _related(found: DataFrame, root: str, name: str) -> DataFrame:
        """Rows with the path below the root under another name."""
        base = F.lit("/" + root.split(":", 1)[-1].strip("/") + "/")
        return found.withColumn("base", base).withColumn(name, F.expr("substring(path, instr(path, base) + length(base))")).drop("base")

    def tasks(self) -> tuple[DataFrame, list[str]]:
        """rel, path, mat_path and metadata of the images to do, and the warnings of those without a pair or metadata."""
        images = batch.paths(self._listed(self.image_root, self.image_exts).select(F.col("rel").alias("path")))
        mats = self._listed(self.mat_root, [".mat"]).filter("path like '%.mat'").select(F.col("rel").alias("mat_path"), F.col("path").alias("mat_file"))
        paired = images.join(mats, "mat_path", "left")
        lost = paired.filter("mat_file is null").select("path").orderBy("path").collect()
        warnings = [f"Missing MAT pair for {r['path']}" for r in lost]
        todo = paired.filter("mat_file is not null")
        if self.skip_existing:
            done = [(str(p.relative_to(self.output_csv_root)),) for p in self.output_csv_root.rglob("*.csv")]
            todo = batch.pending(todo, self.spark.createDataFrame(done, "csv_path string"), "csv_path")
        if self.max_images is not None:
            todo = todo.orderBy("path").limit(self.max_images)
        todo = todo.withColumn("_id", F.col(self.metadata_id_source))
        names = [f"m{i}" for i in range(len(self.metadata_cols))]
        if self.metadata_csv:
            meta = files.read_metadata(self.spark, os.path.expanduser(str(self.metadata_csv)), self.metadata_key_column, list(self.metadata_cols))
            meta = meta.toDF("_id", *names) if self.metadata_key_column not in self.metadata_cols else meta.select(F.col(f"`{self.metadata_key_column}`").alias("_id"), *[F.col(f"`{c}`").alias(n) for c, n in zip(self.metadata_cols, names, strict=True)])
            todo = todo.join(meta.withColumn("_met", F.lit(True)), "_id", "left")
            if not meta.isEmpty():
                warnings += [f"No metadata match for {r['path']} using key '{r['_id']}'" for r in todo.filter("_met is null").orderBy("path").collect()]
        else:
            todo = todo.withColumns({n: F.lit("") for n in names})
        return todo.select(F.col("path").alias("rel"), "mat_path", "csv_path", F.array(*[F.coalesce(n, F.lit("")) for n in names]).cast("array<string>").alias("meta")), warnings

    def results(self, todo: DataFrame, save_crops: bool = False, pre: bool = True, post: bool = True) -> DataFrame:
        """A row of ImageResult for each image to do; writes tables and crops."""
        root = os.path.expanduser(self.image_root)
        images = self._related(files.read_images(self.spark, root, [e.lstrip(".") for e in self.image_exts], self.recursive), root, "rel")
        images = images.select("rel", F.col("path").alias("image_path"), "height", "width", "rgb")
        mat_root = os.path.expanduser(self.mat_root)
        mats = self.spark.read.format("binaryFile").option("recursiveFileLookup", self.recursive).option("pathGlobFilter", "*.mat").load(mat_root)
        mats = self._related(mats, mat_root, "mat_path").select("mat_path", F.col("path").alias("mat_file"), "content")
        rows = todo.join(images, "rel").join(mats, "mat_path").select("image_path", "mat_file", "rel", "csv_path", "meta", "height", "width", "rgb", "content")
        gpu, stain, key, type_key, columns, padding = self.use_gpu, self.stain, self.mat_key, self.inst_type_key, self.metadata_cols, self.padding
        csv_root, nuclei_root = self.output_csv_root, self.output_nuclei_root

        def one(image_path, mat_file, rel, csv_path, meta, h, w, rgb, content) -> ImageResult:
            try:
                if rgb is None:
                    raise ValueError(f"cannot read {image_path}")
                variables = mat.parse(content)
                name, labels = mat.choose(variables, key)
                image = feats.array_of(rgb, "u1", h, w, 3)
                found = extract_features(image, labels, gpu, normalize=stain)
                types, said = mat.types_of(variables, type_key), ()
                if types is None:
                    types, said = {}, (f"{type_key!r} is not in {os.path.basename(mat_file)}; using Unknown nucleus_type",)
                out = [{"nucleus_id": int(r["nucleus_id"]), **dict(zip(columns, meta, strict=True)), "nucleus_type": types.get(int(r["nucleus_id"]), "Unknown"), **{k: v for k, v in r.items() if k != "nucleus_id"}} for r in found]
                if out:
                    write_whole(csv_root / csv_path, csv_of(out, columns))
                    if save_crops:
                        save_crops_of(image, _masks(labels, labels.shape), (nuclei_root / rel).with_suffix(""), padding, pre, post)
                return ImageResult(True, image_path, mat_file, name, len(out), said)
            except Exception as e:  # noqa: BLE001 - whatever goes wrong with an image is its result
                return ImageResult(False, image_path, mat_file, None, 0, (), str(e), traceback.format_exc())

        def run(batches):
            for b in batches:
                for at in range(b.num_rows):
                    r = one(*[c[at].as_py() for c in b.columns])
                    values = [r.ok, r.image_path, r.mat_path, r.mat_key, r.nuclei, list(r.warnings), r.error, r.traceback]
                    kinds = [pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["ok", "image_path", "mat_path", "mat_key", "nuclei", "warnings", "error", "traceback"])

        return rows.mapInArrow(run, "ok boolean, image_path string, mat_path string, mat_key string, nuclei long, warnings array<string>, error string, traceback string")

    def extract(self, *, save_crops: bool = False, save_pre_normalized_crops: bool = True, save_post_normalized_crops: bool = True) -> BatchResult:
        todo, warnings = self.tasks()
        found = self.results(todo, save_crops, save_pre_normalized_crops, save_post_normalized_crops).collect()
        results = sorted((ImageResult(**{**r.asDict(), "warnings": tuple(r["warnings"])}) for r in found), key=lambda r: r.image_path)
        ok = [r for r in results if r.ok]
        return BatchResult(len(results), len(ok), len(results) - len(ok), sum(r.nuclei for r in ok), [*warnings, *[w for r in results for w in r.warnings]], results)

    extract_features = extract

    def extract_and_crop(self, *, save_pre_normalized_crops: bool = True, save_post_normalized_crops: bool = True) -> BatchResult:
        return self.extract(save_crops=True, save_pre_normalized_crops=save_pre_normalized_crops, save_post_normalized_crops=save_post_normalized_crops)


def batch_extract_features(image_root, mat_root, output_csv_root, output_nuclei_root, *, save_crops: bool = False, save_pre_normalized_crops: bool = True, save_post_normalized_crops: bool = True, **kwargs) -> BatchResult:
    b = BatchExtractor(image_root, mat_root, output_csv_root, output_nuclei_root, **kwargs)
    return b.extract(save_crops=save_crops, save_pre_normalized_crops=save_pre_normalized_crops, save_post_normalized_crops=save_post_normalized_crops)


def batch_extract_and_crop(image_root, mat_root, output_csv_root, output_nuclei_root, *, save_crops: bool = True, **kwargs) -> BatchResult:
    return batch_extract_features(image_root, mat_root, output_csv_root, output_nuclei_root, save_crops=save_crops, **kwargs)


def items(value: str) -> tuple[str, ...]:
    """A list that commas part, without blanks."""
    return tuple(x.strip() for x in value.split(",") if x.strip())


def main(argv: Sequence[str] | None = None) -> int:
    """The command line; 0 if there was work and all of it went well."""
    p = argparse.ArgumentParser(description="Features of the nuclei of paired images and MAT files.")
    for name in ("image-root", "mat-root", "output-csv-root", "output-nuclei-root"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--image-exts", type=items, default=IMAGE_EXTS)
    for name, default in (("recursive", True), ("use-gpu", False), ("stain-normalization-features", True), ("save-crops", True), ("save-pre-normalized-crops", True), ("save-post-normalized-crops", True)):
        p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=default)
    p.add_argument("--workers", type=int, help="kept for scripts; Spark's configuration says how many tasks run")
    p.add_argument("--max-images", type=int)
    p.add_argument("--skip-existing", action="store_true")
    p.add_argument("--mat-key")
    p.add_argument("--inst-type-key", default=TYPE_KEY)
    p.add_argument("--padding", type=int, default=PADDING)
    p.add_argument("--metadata-csv")
    p.add_argument("--metadata-key-column", default=METADATA_KEY)
    p.add_argument("--metadata-cols", type=items, default=METADATA_COLS)
    p.add_argument("--metadata-id-source", choices=ID_SOURCES, default="first_dir")
    a = vars(p.parse_args(argv))
    if not a["metadata_csv"]:
        a["metadata_cols"] = ()
    roots = [a.pop(x) for x in ("image_root", "mat_root", "output_csv_root", "output_nuclei_root")]
    try:
        result = batch_extract_and_crop(*roots, **a)
    except Exception as e:  # noqa: BLE001 - said to the user
        print(f"Failed to prepare tasks: {e}")
        return 1
    for w in result.warnings:
        print(f"WARN {w}")
    if not result.tasks_discovered:
        print("No paired image/.mat files found.")
        return 1
    print(f"Discovered {result.tasks_discovered} paired image/.mat tasks.")
    for r in result.results:
        print(f"OK  {os.path.basename(r.image_path)} | nuclei={r.nuclei} | mat_key={r.mat_key}" if r.ok else f"ERR {os.path.basename(r.image_path)} | {r.error}\n{r.traceback}")
    print(f"Completed images: {result.completed_images}\nFailed images: {result.failed_images}\nTotal nuclei saved: {result.total_nuclei}")
    return 1 if result.failed_images else 0
