"""Scenes (points, boxes and cameras of many frames) and transforms of them.

A transform draws its parameters once a frame, from hashes of its seed and the frame, so that a frame's points, boxes and
cameras get the same ones without a join; with p it leaves a share of frames alone. What a transform does to a kind of
table is a kernel: SQL of the changed columns over the parameters' columns. Tables of other kinds pass as they are.

Order matters as it does for single scenes: copy-paste comes before moves, range filters after them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.functions import geom
from cuboid.operators import augment, boxes
from cuboid.operators.boxes import with_exprs

KINDS = ("points", "boxes", "cameras")


@dataclass(frozen=True)
class Scene:
    """points: frame_id, pt_idx, x, y, z, ...; boxes: frame_id, box_idx and the columns of fmt; cameras: frame_id, cam_idx,
    e00 to e23 (frame to camera) and intrinsics. images: whether the frames have camera images."""

    points: DataFrame | None = None
    boxes: DataFrame | None = None
    cameras: DataFrame | None = None
    images: bool = False
    fmt: str = "XYZLWHYPR"

    def replace(self, **parts) -> Scene:
        return replace(self, **parts)


Kernel = Callable[["Transform", str], dict[str, str]]
KERNELS: dict[tuple[type, str], Kernel] = {}


def kernel(transform: type, kind: str) -> Callable[[Kernel], Kernel]:
    """Registers what a transform and its subclasses do to a kind of table: (transform, box format) -> SQL by column."""

    if kind not in KINDS:
        raise TypeError(f"{kind} is no part of a scene")

    def add(f: Kernel) -> Kernel:
        if (transform, kind) in KERNELS:
            raise ValueError(f"{transform.__name__} has a kernel for {kind}")
        KERNELS[transform, kind] = f
        return f

    return add


def find_kernel(transform: type, kind: str) -> Kernel:
    """The kernel of the nearest class in the order of inheritance."""
    for c in transform.__mro__:
        if (c, kind) in KERNELS:
            return KERNELS[c, kind]
    raise TypeError(f"{transform.__name__} has no kernel for {kind}")


class Transform:
    """kinds: what is transformed. p: the share of frames, drawn a frame at a time; contents are refused whatever p is.
    neutral: values of drawn parameters that change nothing; frames left alone get these, so that the expressions of a chain
    of transforms stay small. Without them every column is chosen case by case."""

    kinds: tuple[str, ...] = KINDS
    neutral: dict[str, str] = {}

    def __init__(self, p: float = 1.0, seed: int = 0):
        if not 0 <= p <= 1:
            raise ValueError("p lies within 0 and 1")
        self.p, self.seed = p, seed

    def check(self, scene: Scene) -> None:
        """Raises TypeError for scenes that cannot be transformed."""

    def params(self) -> dict[str, str]:
        """SQL of the parameters of a frame by name; later ones may use earlier ones as _p_name."""
        return {}

    def draw(self, name: str, *more: str) -> str:
        """A number in [0, 1) for every frame."""
        return geom.uniform(self.seed, f"{type(self).__name__}.{name}", "frame_id", *more)

    def goes(self) -> str:
        """Whether a frame is transformed."""
        return "true" if self.p == 1 else f"{self.draw('p')} < {self.p!r}D"

    def apply(self, kind: str, df: DataFrame, scene: Scene) -> DataFrame:
        changed = find_kernel(type(self), kind)(self, scene.fmt)
        made = {f"_p_{n}": e for n, e in self.params().items()}
        if self.p < 1 and self.neutral:
            made |= {f"_p_{n}": f"CASE WHEN {self.goes()} THEN {made[f'_p_{n}']} ELSE {e} END" for n, e in self.neutral.items()}
        elif self.p < 1:
            made["_p"] = self.goes()
            changed = {c: f"CASE WHEN _p THEN {v} ELSE {c} END" for c, v in changed.items()}
        for name, sql in made.items():
            df = df.withColumn(name, F.expr(sql))
        return with_exprs(df, changed).drop(*made)

    def __call__(self, scene: Scene) -> Scene:
        self.check(scene)
        have = {k: getattr(scene, k) for k in self.kinds}
        return scene.replace(**{k: self.apply(k, df, scene) for k, df in have.items() if df is not None})


class Compose:
    """Transforms one after another. All refusals come before any work."""

    def __init__(self, steps: Sequence[Transform]):
        self.steps = list(steps)

    def __call__(self, scene: Scene) -> Scene:
        for step in self.steps:
            step.check(scene)
        for step in self.steps:
            scene = step(scene)
        return scene


class RandomFlip(Transform):
    """Points and boxes mirrored along an axis. A mirrored world does not fit its images: scenes with cameras are refused."""

    kinds = ("points", "boxes")

    def __init__(self, axis: str, p: float = 0.5, seed: int = 0):
        super().__init__(p, seed)
        if axis not in ("x", "y", "z"):
            raise ValueError("an axis is x, y or z")
        self.axis = axis

    def check(self, scene: Scene) -> None:
        if scene.cameras is not None or scene.images:
            raise TypeError("a mirrored scene does not fit its camera images")


class RandomTranslate(Transform):
    """The world moved by up to reach to either side, along each axis."""

    neutral = {c: "0.0D" for c in "xyz"}

    def __init__(self, reach: tuple[float, float, float], p: float = 1.0, seed: int = 0):
        super().__init__(p, seed)
        if min(reach) < 0:
            raise ValueError("a reach is not negative")
        self.reach = reach

    def params(self) -> dict[str, str]:
        return {c: f"{float(r)!r}D*(2*{self.draw(c)}-1)" for c, r in zip("xyz", self.reach, strict=True)}


class RandomRotate(Transform):
    """The world turned by up to reach to either side, about an axis through its origin."""

    neutral = {"angle": "0.0D"}

    def __init__(self, reach: float, axis: tuple[float, float, float] = (0.0, 0.0, 1.0), p: float = 1.0, seed: int = 0):
        super().__init__(p, seed)
        size = sum(a * a for a in axis) ** 0.5
        if not size or reach < 0:
            raise ValueError("an axis has a length and a reach is not negative")
        self.reach, self.axis = reach, tuple(a / size for a in axis)

    def check(self, scene: Scene) -> None:
        if scene.boxes is None:
            return
        if scene.fmt in ("XYZXYZ", "XYZLWH"):
            raise NotImplementedError("axis-aligned boxes cannot be rotated")
        if scene.fmt == "XYZLWHY" and max(map(abs, self.axis[:2])) > 1e-6:
            raise ValueError("boxes with a yaw alone turn about z only")

    def params(self) -> dict[str, str]:
        out = {"angle": f"{float(self.reach)!r}D*(2*{self.draw('angle')}-1)", "c": "cos(_p_angle)", "s": "sin(_p_angle)"}
        k, cross = self.axis, {(0, 1): (-1, 2), (0, 2): (1, 1), (1, 0): (1, 2), (1, 2): (-1, 0), (2, 0): (-1, 1), (2, 1): (1, 0)}
        for i in range(3):
            for j in range(3):
                sign, axis = cross.get((i, j), (0, 0))
                out[f"m{i}{j}"] = f"{k[i] * k[j]!r}D*(1-_p_c)+{sign * k[axis]!r}D*_p_s" + ("+_p_c" if i == j else "")
        return out


class RandomScale(Transform):
    """The world grown by a factor within low and high."""

    neutral = {"f": "1.0D"}

    def __init__(self, low: float, high: float, p: float = 1.0, seed: int = 0):
        super().__init__(p, seed)
        if not 0 < low <= high:
            raise ValueError("scales are positive and ordered")
        self.low, self.high = low, high

    def params(self) -> dict[str, str]:
        return {"f": f"{float(self.low)!r}D+{float(self.high - self.low)!r}D*{self.draw('f')}"}


class PointJitter(Transform):
    """Normal noise on every point's x, y and z; features stay."""

    kinds = ("points",)
    neutral = {"sigma": "0.0D"}

    def __init__(self, sigma: float, p: float = 1.0, seed: int = 0):
        super().__init__(p, seed)
        if sigma < 0:
            raise ValueError("sigma is not negative")
        self.sigma = sigma

    def params(self) -> dict[str, str]:
        return {"sigma": f"{float(self.sigma)!r}D"}


class PointShuffle(Transform):
    """Points of a frame numbered in a random order."""

    kinds = ("points",)

    def apply(self, kind: str, df: DataFrame, scene: Scene) -> DataFrame:
        return augment.shuffle_points(df, ["pt_idx"], self.seed, F.expr(self.goes()))


class PointSample(Transform):
    """n points of every frame: none twice where it has as many, drawn with replacement otherwise."""

    kinds = ("points",)

    def __init__(self, n: int, seed: int = 0):
        super().__init__(1.0, seed)
        if n < 1:
            raise ValueError("a sample has one point at least")
        self.n = n

    def apply(self, kind: str, df: DataFrame, scene: Scene) -> DataFrame:
        return augment.sample_points(df, self.n, ["pt_idx"], self.seed).drop("pt_idx").withColumnRenamed("slot", "pt_idx")


class RangeFilter(Transform):
    """Points, and boxes by their centre, within a half-open range."""

    kinds = ("points", "boxes")

    def __init__(self, low: tuple[float, float, float], high: tuple[float, float, float]):
        super().__init__()
        self.low, self.high = low, high

    def apply(self, kind: str, df: DataFrame, scene: Scene) -> DataFrame:
        names = ("x", "y", "z") if kind == "points" else geom.columns(scene.fmt)[:6]
        df = settled(df, names)
        if kind == "points" or scene.fmt != "XYZXYZ":
            return boxes.range_filter(df, self.low, self.high, names[:3])
        for c, a, b in zip("xyz", self.low, self.high, strict=True):
            middle = (F.col(f"{c}1") + F.col(f"{c}2")) / 2
            df = df.filter((middle >= a) & (middle < b))
        return df


def settled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with columns worked out once, here: a filter on them is not moved below what makes them, where it would repeat a
    whole chain of transforms for every bound."""
    made = F.inline(F.array(F.struct(*names)))
    return df.select(*[c for c in df.columns if c not in names], made).select(*df.columns)


_COLUMNS = ("cx", "cy", "cz")


def _turn(names: tuple[str, str, str]) -> dict[str, str]:
    return {n: "+".join(f"_p_m{i}{j}*{names[j]}" for j in range(3)) for i, n in enumerate(names)}


def _cells(of: Callable[[int, int], str]) -> dict[str, str]:
    return {f"e{i}{j}": of(i, j) for i in range(3) for j in range(4)}


@kernel(RandomFlip, "points")
def _(t, fmt):
    return {t.axis: f"-{t.axis}"}


@kernel(RandomFlip, "boxes")
def _(t, fmt):
    return geom.flip(t.axis, fmt)


@kernel(RandomTranslate, "points")
def _(t, fmt):
    return {c: f"{c}+_p_{c}" for c in "xyz"}


@kernel(RandomTranslate, "boxes")
def _(t, fmt):
    moved = [f"{c}{k}" for c in "xyz" for k in "12"] if fmt == "XYZXYZ" else _COLUMNS
    return {c: f"{c}+_p_{c.strip('c12')}" for c in moved}


@kernel(RandomTranslate, "cameras")
def _(t, fmt):
    return {f"e{i}3": "-".join([f"e{i}3", *[f"e{i}{k}*_p_{c}" for k, c in enumerate("xyz")]]) for i in range(3)}


@kernel(RandomRotate, "points")
def _(t, fmt):
    return _turn(("x", "y", "z"))


@kernel(RandomRotate, "boxes")
def _(t, fmt):
    """The turn's own angles are added to the boxes', as geom.rotate_boxes does."""
    out = _turn(_COLUMNS) | {"yaw": "yaw+atan2(_p_m10, _p_m00)"}
    if fmt == "XYZLWHYPR":
        out |= {"pitch": "pitch+atan2(-_p_m20, sqrt(_p_m21*_p_m21+_p_m22*_p_m22))", "roll": "roll+atan2(_p_m21, _p_m22)"}
    return out


@kernel(RandomRotate, "cameras")
def _(t, fmt):
    return _cells(lambda i, j: f"e{i}3" if j == 3 else "+".join(f"e{i}{k}*_p_m{j}{k}" for k in range(3)))


@kernel(RandomScale, "points")
def _(t, fmt):
    return {c: f"{c}*_p_f" for c in "xyz"}


@kernel(RandomScale, "boxes")
def _(t, fmt):
    return {c: f"{c}*_p_f" for c in geom.columns(fmt)[:6]}


@kernel(RandomScale, "cameras")
def _(t, fmt):
    """Depths grow, pixels stay."""
    return {f"e{i}3": f"e{i}3*_p_f" for i in range(3)}


@kernel(PointJitter, "points")
def _(t, fmt):
    noise = lambda c: f"_p_sigma*sqrt(-2*ln(1-{t.draw(c + '1', 'pt_idx')}))*cos(2*pi()*{t.draw(c + '2', 'pt_idx')})"
    return {c: f"{c}+CASE WHEN _p_sigma > 0 THEN {noise(c)} ELSE 0.0D END" for c in "xyz"}
