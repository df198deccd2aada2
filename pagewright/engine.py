"""One task's engine: which nets it holds, what it refuses, and the stages of a read."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.backends import InferenceBackend, greedy
from pagewright.errors import Refused
from pagewright.operators import catalog, pixels

# The nets an engine may hold.
NETS = ("det", "ori", "rec")


def chosen_nets(nets: Sequence[str] | None, orients: bool) -> tuple[str, ...]:
    """The nets asked for; without a wish all that the profile has."""
    if nets is None:
        return NETS if orients else ("det", "rec")
    if not nets or not set(nets) <= set(NETS):
        raise Refused("nets-invalid", f"nets are some of {', '.join(NETS)}")
    return tuple(nets)


def target_side(value: Any) -> int:
    try:
        side = int(value)
    except (TypeError, ValueError):
        side = 0
    if side < 1:
        raise Refused("target-size-invalid", f"{value!r} is no length above zero")
    return side


def run_options(options: dict[str, bool] | None = None, *, accelerated: bool | None = None, half: bool | None = None) -> dict[str, bool]:
    """Flags as given, or those of the older switches; both together are refused."""
    if options is not None and (accelerated, half) != (None, None):
        raise Refused("options-conflict", "give flags or switches, not both")
    if options is not None:
        return options
    return catalog.options("fp16" if half else "fp32") | {"accelerated": accelerated is not False}


def pixels_of(image: Any, code: str = "image-invalid", height: int | None = None) -> np.ndarray:
    """The image, if it is bytes by height, width and three channels (of one height, for a line's patch)."""
    if not isinstance(image, np.ndarray) or image.ndim != 3 or image.shape[2] != 3:
        raise Refused(code, f"{getattr(image, 'shape', type(image).__name__)} is not height x width x 3")
    if image.dtype != np.uint8:
        raise Refused(code, f"{image.dtype} are no bytes")
    if not image.size or height not in (None, image.shape[0]):
        raise Refused(code, f"a side is {'empty' if not image.size else f'{image.shape[0]}, not {height}'}")
    return image


def absent_files(spark: SparkSession, models: DataFrame, root: str, nets: Sequence[str]) -> DataFrame:
    """Files (profile, path) that the nets of profiles need below ``root`` and that are not there; a dictionary is always needed.

    ``models``: rows of ``catalog.model_files``.
    """
    graphs = F.explode(F.array(*(F.col(net) for net in nets)))
    needed = models.select("profile", graphs.alias("graph")).select("profile", F.explode(F.array("graph", F.regexp_replace("graph", r"\.param$", ".bin"))).alias("path"))
    needed = needed.unionByName(models.select("profile", F.col("dictionary").alias("path"))).where("path is not null").distinct()
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    at = at.makeQualified(system.getUri(), system.getWorkingDirectory())
    if not system.exists(at):
        return needed
    # Paths below the root, so that they are joined by equality; contents are not read.
    inner = F.ltrim(F.expr(f"substring(path, {len(at.toString()) + 1})"), F.lit("/"))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path")).select(inner.alias("path"))
    return needed.join(there, "path", "left_anti").select("profile", "path")


def require_files(spark: SparkSession, models: DataFrame, root: str, nets: Sequence[str]) -> None:
    """Refuses to go on when a file is absent, all that are being named."""
    if absent := absent_files(spark, models, root, nets).orderBy("path").limit(20).collect():
        raise Refused("model-missing", ", ".join(sorted({f"{root}/{r['path']}" for r in absent})))


def guarded(stage: str, operation: str, step: Callable, *values: Any) -> Any:
    """What a back end's step gives; whatever it raises is refused under the stage's code."""
    try:
        return step(*values)
    except Refused:
        raise
    except Exception as failure:  # noqa: BLE001 - back ends fail in ways of their own
        said = str(failure) or type(failure).__name__
    raise Refused(f"{stage}-inference-failed", f"{operation} failed: {said}")


class Engine:
    """A back end with its nets loaded; closed at the end of its ``with``, or if it cannot be opened."""

    def __init__(self, factory: Callable[[], InferenceBackend], dictionary: Sequence[str], *, nets: Sequence[str] | None = None, target: Any = pixels.TARGET, offset: int = 1, angles: Sequence[int] = (0, 180)):
        self.nets = chosen_nets(nets, True)
        self.target = target_side(target)
        if len(dictionary) < 2:
            raise Refused("dictionary-invalid", f"{len(dictionary)} classes")
        self.dictionary, self.offset, self.angles = list(dictionary), offset, tuple(angles)
        self.backend: InferenceBackend | None = None
        try:
            self.backend = factory()
            self.backend.load()
        except BaseException as failure:
            self.close()
            if isinstance(failure, ImportError):
                raise Refused("runtime-missing", str(failure) or type(failure).__name__) from None
            if isinstance(failure, FileNotFoundError):
                raise Refused("model-missing", str(failure)) from None
            if isinstance(failure, Exception) and not isinstance(failure, Refused):
                raise Refused("model-invalid", str(failure) or type(failure).__name__) from None
            raise

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        backend, self.backend = self.backend, None
        if backend is not None:
            backend.close()

    def _net(self, name: str) -> InferenceBackend:
        if name not in self.nets or self.backend is None:
            raise Refused("net-unloaded", f"this engine holds no {name}")
        return self.backend

    def detect(self, image: np.ndarray) -> list[pixels.Region]:
        net = self._net("det")
        padded, scale_x, scale_y, wpad, hpad = pixels.detector_input(pixels_of(image), self.target)
        output = np.asarray(guarded("detection", "extract", net.detect, pixels.normalised(padded, pixels.DET_MEAN, pixels.DET_NORM)))
        if output.shape != (1, *padded.shape[:2]):
            raise Refused("detection-output-invalid", f"a map of {output.shape} for a page of {padded.shape[:2]}")
        return pixels.regions(output[0], scale_x, scale_y, wpad, hpad)

    def crops(self, image: np.ndarray) -> Iterator[tuple[pixels.Region, np.ndarray]]:
        """Regions with their patches, upright; empty patches are left out."""
        for region in self.detect(image):
            patch = pixels.crop(image, region)
            if patch.size:
                yield region, self.upright(patch)[0] if "ori" in self.nets else patch

    def upright(self, patch: np.ndarray) -> tuple[np.ndarray, int, float]:
        """(the patch turned upright, the angle, its score)."""
        net = self._net("ori")
        scores = np.asarray(guarded("orientation", "extract", net.orient, pixels.orientation_input(patch)), float).reshape(-1)
        if len(scores) != len(self.angles):
            raise Refused("orientation-inference-failed", f"{len(scores)} scores for {len(self.angles)} angles")
        best = int(scores.argmax())
        return pixels.rotated(patch, self.angles[best]), self.angles[best], float(scores[best])

    def logits(self, patch: np.ndarray) -> np.ndarray:
        """Of a patch of a line's height: scores by time step and class."""
        net = self._net("rec")
        return np.asarray(guarded("recognition", "extract", net.recognise, pixels.line_input(pixels_of(patch, "patch-invalid", pixels.PATCH_HEIGHT))))

    def decode(self, logits: np.ndarray) -> tuple[str, float]:
        return greedy(logits, self.dictionary, self.offset)

    def read(self, image: np.ndarray) -> list[tuple[pixels.Region, str, float]]:
        """(region, text, confidence) of each region of a page."""
        return [(region, *self.decode(self.logits(patch))) for region, patch in self.crops(image)]

    def read_packed(self, patches: Sequence[np.ndarray], gap: int = 32) -> list[tuple[str, float]]:
        """Texts of patches that go through the recogniser side by side, as one strip."""
        strip, spans = pixels.packed(patches, gap)
        scores = self.logits(strip)
        per_pixel = len(scores) / strip.shape[1]
        lo = [round(a * per_pixel) for a, _ in spans]
        hi = [max(round(b * per_pixel), a + 1) for (_, b), a in zip(spans, lo, strict=True)]
        return [self.decode(scores[a:b]) for a, b in zip(lo, hi, strict=True)]

    def read_grouped(self, patches: Sequence[np.ndarray], widest: int) -> list[tuple[str, float]]:
        """Patches up to so many pixels wide as one strip, wider ones alone, in the order given."""
        narrow = [i for i, p in enumerate(patches) if p.shape[1] <= widest]
        done: dict[int, tuple[str, float]] = dict(zip(narrow, self.read_packed([patches[i] for i in narrow]), strict=True)) if narrow else {}
        return [done[i] if i in done else self.decode(self.logits(p)) for i, p in enumerate(patches)]


def some(items: Iterable, what: str) -> list:
    """The items, if there are any."""
    found = list(items)
    if not found:
        raise ValueError(f"nothing to do: no {what}")
    return found


def way_of_reading(workers: Column, crops: Column) -> Column:
    """How a page's crops are read: by the engine itself where there is no pool, by a spare one where its workers are all gone."""
    return F.when(workers.isNull(), "alone").when(crops == 0, "nothing").when(workers == 0, "spare").otherwise("pool")
