"""Geometry as SQL expressions over scalar columns, so that it stays inside whole-stage code generation.

A box is (cx, cy, cz, l, w, h, yaw, pitch, roll): l along x, w along y, h along z; intrinsic z-y'-x'' angles in radians.
"""

from __future__ import annotations

BOX = ("cx", "cy", "cz", "l", "w", "h", "yaw", "pitch", "roll")
FORMATS = ("XYZXYZ", "XYZLWH", "XYZLWHY", "XYZLWHYPR")
#: Signs of a box's corners in l, w, h: the lower face counter-clockwise, then the upper one.
CORNERS = ((-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1))


def rotation(yaw: str = "yaw", pitch: str = "pitch", roll: str = "roll") -> dict[str, str]:
    """r00 to r22 of Rz(yaw) Ry(pitch) Rx(roll); its columns are the box's axes."""
    cy, sy, cp, sp, cr, sr = (f"{f}({a})" for a in (yaw, pitch, roll) for f in ("cos", "sin"))
    return {
        "r00": f"{cy}*{cp}", "r01": f"{cy}*{sp}*{sr}-{sy}*{cr}", "r02": f"{cy}*{sp}*{cr}+{sy}*{sr}",
        "r10": f"{sy}*{cp}", "r11": f"{sy}*{sp}*{sr}+{cy}*{cr}", "r12": f"{sy}*{sp}*{cr}-{cy}*{sr}",
        "r20": f"-{sp}", "r21": f"{cp}*{sr}", "r22": f"{cp}*{cr}",
    }


def contains(x: str = "x", y: str = "y", z: str = "z") -> str:
    """Whether a point lies in a box (borders included), given r00 to r22 and the box's columns."""
    d = (f"({x}-cx)", f"({y}-cy)", f"({z}-cz)")
    local = ["+".join(f"r{k}{axis}*{d[k]}" for k in range(3)) for axis in range(3)]
    return " AND ".join(f"abs({v})<={size}/2" for v, size in zip(local, "lwh", strict=True))


def corner(k: int) -> tuple[str, str, str]:
    """x, y, z of corner k, given r00 to r22."""
    signs = CORNERS[k]
    return tuple(f"c{'xyz'[i]}+(" + "+".join(f"({s})*r{i}{j}*{size}/2" for j, (s, size) in enumerate(zip(signs, "lwh", strict=True))) + ")" for i in range(3))


def convert(source: str, target: str) -> dict[str, str]:
    """Columns of the target format from those of the source (corner formats use x1, y1, z1, x2, y2, z2)."""
    source, target = source.upper(), target.upper()
    if source not in FORMATS or target not in FORMATS:
        raise ValueError(f"unknown box format: {source} or {target}")
    low, high, centre, size = ("x1", "y1", "z1"), ("x2", "y2", "z2"), ("cx", "cy", "cz"), ("l", "w", "h")
    if source == target:
        names = {"XYZXYZ": low + high, "XYZLWH": centre + size, "XYZLWHY": BOX[:7], "XYZLWHYPR": BOX}[source]
        return {n: n for n in names}
    if (source, target) == ("XYZXYZ", "XYZLWH"):
        return {c: f"({a}+{b})/2" for c, a, b in zip(centre, low, high, strict=True)} | {s: f"{b}-{a}" for s, a, b in zip(size, low, high, strict=True)}
    if (source, target) == ("XYZLWH", "XYZXYZ"):
        return {a: f"{c}-{s}/2" for a, c, s in zip(low, centre, size, strict=True)} | {b: f"{c}+{s}/2" for b, c, s in zip(high, centre, size, strict=True)}
    raise NotImplementedError(f"no conversion from {source} to {target}")


def columns(fmt: str) -> tuple[str, ...]:
    """The columns of a box format."""
    return tuple(convert(fmt, fmt))


def flip(axis: str, fmt: str = "XYZLWHYPR") -> dict[str, str]:
    """A box mirrored along an axis. Corners swap; a box with a yaw only turns for x and y, not for z."""
    if fmt == "XYZXYZ":
        return {c: f"-{c[0]}{3 - int(c[1])}" if c[0] == axis else c for c in columns(fmt)}
    turned = {"x": ("yaw", "pitch"), "y": ("yaw", "roll"), "z": ("pitch", "roll")}[axis]
    return {c: f"-{c}" if c == f"c{axis}" or c in turned else c for c in columns(fmt)}


def translate(offset: tuple[float, float, float], fmt: str = "XYZLWHYPR") -> dict[str, str]:
    """A moved box; both corners move."""
    by = dict(zip("xyz", offset, strict=True))
    return {c: f"{c}+({by[c.strip('c12')]!r})" if c.strip("c12") in by else c for c in columns(fmt)}


def axis_rotation(axis: tuple[float, float, float], angle: float) -> list[list[float]]:
    """The rotation by angle about an axis of any length."""
    import math

    size = math.sqrt(sum(a * a for a in axis))
    if not size:
        raise ValueError("the axis has no length")
    x, y, z = (a / size for a in axis)
    c, s = math.cos(angle), math.sin(angle)
    k = 1 - c
    return [[c + x * x * k, x * y * k - z * s, x * z * k + y * s], [y * x * k + z * s, c + y * y * k, y * z * k - x * s], [z * x * k - y * s, z * y * k + x * s, c + z * z * k]]


def rotate_point(m: list[list[float]], names: tuple[str, str, str] = ("x", "y", "z")) -> dict[str, str]:
    return {n: "+".join(f"({m[i][j]!r})*{names[j]}" for j in range(3)) for i, n in enumerate(names)}


def rotate_boxes(axis: tuple[float, float, float], angle: float, fmt: str) -> dict[str, str]:
    """Boxes turned about an axis. Axis-aligned formats cannot turn; with a yaw alone only about z; with three
    angles the rotation's own angles are added to them, one by one (the contract, not a true composition)."""
    import math

    m = axis_rotation(axis, angle)
    if fmt in ("XYZXYZ", "XYZLWH"):
        raise NotImplementedError("axis-aligned boxes cannot be rotated")
    if fmt == "XYZLWHY" and max(abs(m[0][2]), abs(m[1][2]), abs(m[2][0]), abs(m[2][1])) > 1e-6:
        raise ValueError("boxes with a yaw alone turn about z only")
    out = rotate_point(m, ("cx", "cy", "cz")) | {c: c for c in "lwh"}
    out["yaw"] = f"yaw+({math.atan2(m[1][0], m[0][0])!r})"
    if fmt == "XYZLWHYPR":
        out["pitch"] = f"pitch+({math.asin(max(-1.0, min(1.0, -m[2][0])))!r})"
        out["roll"] = f"roll+({math.atan2(m[2][1], m[2][2])!r})"
    return out


def separated(a: str = "a", b: str = "b") -> list[str]:
    """The 15 tests of two oriented boxes, each true if its axis does not separate them (touching overlaps).

    Columns of the two sides carry the prefixes a_ and b_."""
    ca, cb = (lambda c: f"{a}_{c}"), (lambda c: f"{b}_{c}")
    d = [f"({cb(c)}-{ca(c)})" for c in ("cx", "cy", "cz")]
    ha, hb = [f"{ca(s)}/2" for s in "lwh"], [f"{cb(s)}/2" for s in "lwh"]
    A = [[ca(f"r{i}{j}") for i in range(3)] for j in range(3)]
    B = [[cb(f"r{i}{j}") for i in range(3)] for j in range(3)]
    dot = lambda u, v: "(" + "+".join(f"{x}*{y}" for x, y in zip(u, v, strict=True)) + ")"
    cross = lambda u, v: [f"({u[1]}*{v[2]}-{u[2]}*{v[1]})", f"({u[2]}*{v[0]}-{u[0]}*{v[2]})", f"({u[0]}*{v[1]}-{u[1]}*{v[0]})"]
    axes = A + B + [cross(u, v) for u in A for v in B]
    reach = lambda h, axis, n: "+".join(f"{h[k]}*abs({dot(axis[k], n)})" for k in range(3))
    return [f"abs({dot(d, n)})<={reach(ha, A, n)}+{reach(hb, B, n)}" for n in axes]


def aligned_iou(a: str = "a", b: str = "b") -> str:
    """IoU of two boxes as if they had no angles; 0 where the union has no volume."""
    over = "*".join(f"greatest(0.0,least({a}_{c}+{a}_{s}/2,{b}_{c}+{b}_{s}/2)-greatest({a}_{c}-{a}_{s}/2,{b}_{c}-{b}_{s}/2))" for c, s in (("cx", "l"), ("cy", "w"), ("cz", "h")))
    union = f"({a}_l*{a}_w*{a}_h+{b}_l*{b}_w*{b}_h-({over}))"
    return f"CASE WHEN {union}>0 THEN ({over})/{union} ELSE 0.0 END"


def yaw_iou(a: str = "a", b: str = "b") -> list[dict[str, str]]:
    """iou of two boxes with a yaw (pitch and roll ignored), as columns to be worked out step by step.

    The common area of two rectangles is half the sum, over the edges of both, of the part of the edge inside the other
    rectangle times the edge's distance from a common origin (here b's centre) times its length. In the frame of the other
    rectangle that part is cut out by two pairs of parallel lines. An edge along the other's edge counts once: a's, if both
    rectangles lie on the same side of it."""
    c = lambda s, n: f"{s}_{n}"
    dx, dy = f"({c(a, 'cx')}-{c(b, 'cx')})", f"({c(a, 'cy')}-{c(b, 'cy')})"
    first = {"_c": f"cos({c(a, 'yaw')}-{c(b, 'yaw')})", "_s": f"sin({c(a, 'yaw')}-{c(b, 'yaw')})"}
    for s, sign in ((b, ""), (a, "-")):  # the other centre in the frame of s
        cos, sin = f"cos({c(s, 'yaw')})", f"sin({c(s, 'yaw')})"
        first |= {f"_{s}u": f"{sign}({cos}*{dx}+{sin}*{dy})", f"_{s}v": f"{sign}({cos}*{dy}-{sin}*{dx})"}
    second, third, terms = {}, {}, []
    for s, o, turn in ((a, b, "_s"), (b, a, "-_s")):
        hl, hw, ol, ow = f"{c(s, 'l')}/2", f"{c(s, 'w')}/2", f"{c(o, 'l')}/2", f"{c(o, 'w')}/2"
        for k, (i, j, along) in enumerate(((1, -1, "l"), (1, 1, "w"), (-1, 1, "l"), (-1, -1, "w"))):  # ends of edges, counter-clockwise
            start = {0: (-1, -1), 1: (1, -1), 2: (1, 1), 3: (-1, 1)}[k]
            x, y = f"({start[0]}*{hl})", f"({start[1]}*{hw})"
            ex, ey = f"({i - start[0]}*{hl})", f"({j - start[1]}*{hw})"
            n = f"_{s}{k}"
            second |= {f"{n}x": f"_{o}u+_c*{x}-({turn})*{y}", f"{n}y": f"_{o}v+({turn})*{x}+_c*{y}", f"{n}p": f"_c*{ex}-({turn})*{ey}", f"{n}q": f"({turn})*{ex}+_c*{ey}"}
            size, ends = c(s, along), []
            for at, go, half, outward in ((f"{n}x", f"{n}p", ol, f"{n}q*{n}x"), (f"{n}y", f"{n}q", ow, f"-{n}p*{n}y")):
                flat = f"abs({go}) <= 1e-9*{size}"
                beside = f"abs(abs({at})-{half}) <= 1e-9*(1+{half})"
                kept = f"{outward} > 0" if s == a else "1 = 0"
                out = f"({beside} AND NOT ({kept})) OR (NOT ({beside}) AND abs({at}) > {half})"
                low, high = f"(-{half}-{at})/{go}", f"({half}-{at})/{go}"
                ends.append((f"CASE WHEN {flat} THEN CASE WHEN {out} THEN 2.0 ELSE 0.0 END ELSE least({low}, {high}) END", f"CASE WHEN {flat} THEN 1.0 ELSE greatest({low}, {high}) END"))
            third |= {f"{n}a": f"greatest(0.0, {ends[0][0]}, {ends[1][0]})", f"{n}b": f"least(1.0, {ends[0][1]}, {ends[1][1]})"}
            lever = f"({n}x*{n}q-{n}y*{n}p)" if s == a else f"({c(b, 'l')}*{c(b, 'w')}/2)"
            terms.append(f"greatest(0.0, {n}b-{n}a)*{lever}")
    over = f"greatest(0.0, least({c(a, 'cz')}+{c(a, 'h')}/2, {c(b, 'cz')}+{c(b, 'h')}/2)-greatest({c(a, 'cz')}-{c(a, 'h')}/2, {c(b, 'cz')}-{c(b, 'h')}/2))"
    fourth = {"_volume": f"greatest(0.0, ({'+'.join(terms)})/2)*{over}"}
    both = f"({c(a, 'l')}*{c(a, 'w')}*{c(a, 'h')}+{c(b, 'l')}*{c(b, 'w')}*{c(b, 'h')}-_volume)"
    return [first, second, third, fourth, {"iou": f"CASE WHEN {both} > 0 THEN _volume/{both} ELSE 0.0 END"}]


def uniform(seed: int, purpose: str, *parts: str) -> str:
    """A number in [0, 1) that depends on the values of parts only (the same in any partitioning)."""
    text = "concat_ws('|'," + ",".join([f"'{seed}'", f"'{purpose}'", *[f"cast({p} AS string)" for p in parts]]) + ")"
    return f"(cast(conv(substr(md5({text}),1,8),16,10) AS bigint)/4294967296.0D)"
