"""Rigid transforms as 12 scalar columns p00 to p23 (a rotation and an offset, row by row), composed and inverted as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cuboid.operators.boxes import with_exprs


def names(p: str) -> list[str]:
    """The columns of the transform with the prefix p."""
    return [f"{p}{i}{j}" for i in range(3) for j in range(4)]


def quaternion(q: str) -> dict[str, str]:
    """SQL of the rotation matrix of a unit quaternion (w, x, y, z) in an array column, by row and column."""
    w, x, y, z = (f"{q}[{i}]" for i in range(4))
    return {
        "00": f"1-2*({y}*{y}+{z}*{z})", "01": f"2*({x}*{y}-{z}*{w})", "02": f"2*({x}*{z}+{y}*{w})",
        "10": f"2*({x}*{y}+{z}*{w})", "11": f"1-2*({x}*{x}+{z}*{z})", "12": f"2*({y}*{z}-{x}*{w})",
        "20": f"2*({x}*{z}-{y}*{w})", "21": f"2*({y}*{z}+{x}*{w})", "22": f"1-2*({x}*{x}+{y}*{y})",
    }


def of_pose(p: str, rotation: str, translation: str) -> dict[str, str]:
    """The transform of a pose: a unit quaternion and an offset in array columns."""
    turn = quaternion(rotation)
    return {f"{p}{i}{j}": f"{translation}[{i}]" if j == 3 else turn[f"{i}{j}"] for i in range(3) for j in range(4)}


def compose(p: str, a: str, b: str) -> dict[str, str]:
    """The transform that does b first, then a."""
    cell = lambda i, j: "+".join(f"{a}{i}{k}*{b}{k}{j}" for k in range(3)) + (f"+{a}{i}3" if j == 3 else "")
    return {f"{p}{i}{j}": cell(i, j) for i in range(3) for j in range(4)}


def inverse(p: str, a: str) -> dict[str, str]:
    """The transform that undoes a."""
    cell = lambda i, j: "-(" + "+".join(f"{a}{k}{i}*{a}{k}3" for k in range(3)) + ")" if j == 3 else f"{a}{j}{i}"
    return {f"{p}{i}{j}": cell(i, j) for i in range(3) for j in range(4)}


def moved(a: str, xyz: tuple[str, str, str] = ("x", "y", "z")) -> dict[str, str]:
    """Points carried by a."""
    return {c: "+".join(f"{a}{i}{k}*{xyz[k]}" for k in range(3)) + f"+{a}{i}3" for i, c in enumerate(xyz)}


def chain(df: DataFrame, p: str, *steps: str) -> DataFrame:
    """df with the transform p, the product of the transforms of its columns with the prefixes of steps, last one first; a
    step with a leading - is undone. Each product is worked out once, in columns of its own."""
    done, k, drop = None, 0, []
    for step in reversed(steps):
        if step.startswith("-"):
            df = with_exprs(df, inverse(f"_{p}i{k}_", step[1:]))
            step, drop = f"_{p}i{k}_", [*drop, *names(f"_{p}i{k}_")]
        if done is not None:
            df = with_exprs(df, compose(f"_{p}c{k}_", step, done))
            step, drop = f"_{p}c{k}_", [*drop, *names(f"_{p}c{k}_")]
        done, k = step, k + 1
    return with_exprs(df, {a: b for a, b in zip(names(p), names(done), strict=True)}).drop(*drop)
