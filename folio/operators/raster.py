"""Images as pixel tables (image_id, x, y, r, g, b, a): geometry, colour, filters and layers.

An image is what a task works on: rows are dealt by image once, and every window after that
keeps to the image, so row and column passes need no further shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import clamp8, half_up
from folio.operators.components import pixels_of, reached_runs
from folio.sources.tables import written

KEY = ["image_id", "x", "y"]


def by_image():
    return Window.partitionBy("image_id")


def by_row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def by_column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def sized(px: DataFrame) -> DataFrame:
    """With the width and height of each image."""
    return px.withColumns({"width": F.max("x").over(by_image()) + 1, "height": F.max("y").over(by_image()) + 1})


def each(px: DataFrame, f, names: str = "rgb") -> DataFrame:
    return px.withColumns({c: f(F.col(c)) for c in names})


def luma() -> Column:
    return 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")


def crop_px(px: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """A window, rounded and held inside the image, moved to 0, 0."""
    s = sized(px)
    x0, y0 = F.greatest(F.lit(0), half_up(F.lit(float(x)))), F.greatest(F.lit(0), half_up(F.lit(float(y))))
    x1, y1 = F.least(F.col("width"), x0 + half_up(F.lit(float(w)))), F.least(F.col("height"), y0 + half_up(F.lit(float(h))))
    kept = s.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return kept.withColumns({"x": (F.col("x") - x0).cast("int"), "y": (F.col("y") - y0).cast("int")}).drop("width", "height")


def flip_px(px: DataFrame, horizontal: bool) -> DataFrame:
    c, n = ("x", "width") if horizontal else ("y", "height")
    return sized(px).withColumn(c, F.col(n) - 1 - F.col(c)).drop("width", "height")


def turn_px(px: DataFrame, clockwise: bool = True) -> DataFrame:
    x, y = (F.col("height") - 1 - F.col("y"), F.col("x")) if clockwise else (F.col("y"), F.col("width") - 1 - F.col("x"))
    return sized(px).withColumns({"x": x, "y": y}).drop("width", "height")


def grid(images: DataFrame, w: int, h: int) -> DataFrame:
    return images.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x")).select("image_id", "x", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y"))


def resize_canvas(px: DataFrame, w: int, h: int, anchor: str = "c") -> DataFrame:
    """A canvas of another size; what is new is transparent, what is over is cut."""
    s = sized(px)
    dx = F.lit(0) if "l" in anchor else w - F.col("width") if "r" in anchor else F.floor((w - F.col("width")) / 2)
    dy = F.lit(0) if "t" in anchor else h - F.col("height") if "b" in anchor else F.floor((h - F.col("height")) / 2)
    moved = s.select("image_id", (F.col("x") + dx).cast("int").alias("x"), (F.col("y") + dy).cast("int").alias("y"), *"rgba")
    return grid(px, w, h).join(moved, KEY, "left").na.fill(0, list("rgba"))


def resize_px(px: DataFrame, w: int, h: int) -> DataFrame:
    """Area mean where it shrinks, nearest sample where it grows."""
    s = sized(px)
    cell = {"x": F.floor(F.col("x") * w / F.col("width")).cast("int"), "y": F.floor(F.col("y") * h / F.col("height")).cast("int")}
    small = s.where((F.col("width") >= w) & (F.col("height") >= h)).withColumns(cell).groupBy(*KEY).agg(*[clamp8(F.avg(c)).alias(c) for c in "rgba"])
    large = s.where((F.col("width") < w) | (F.col("height") < h))
    at = grid(large, w, h).withColumnsRenamed({"x": "nx", "y": "ny"}).join(large.select("image_id", "width", "height").distinct(), "image_id")
    at = at.select("image_id", "nx", "ny", F.floor(F.col("nx") * F.col("width") / w).cast("int").alias("x"), F.floor(F.col("ny") * F.col("height") / h).cast("int").alias("y"))
    grown = at.join(large.select(*KEY, *"rgba"), KEY).select("image_id", F.col("nx").alias("x"), F.col("ny").alias("y"), *"rgba")
    return small.unionByName(grown)


def trim_px(px: DataFrame, least: int = 8) -> DataFrame:
    """The box of pixels with alpha above ``least``; an empty image stays."""
    seen = F.col("a") > least
    b = px.withColumns({f"{f}{c}": getattr(F, f)(F.when(seen, F.col(c))).over(by_image()) for f in ("min", "max") for c in "xy"})
    inside = F.col("minx").isNull() | (F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy")))
    kept = b.where(inside)
    return kept.withColumns({"x": F.col("x") - F.coalesce("minx", F.lit(0)), "y": F.col("y") - F.coalesce("miny", F.lit(0))}).drop("minx", "maxx", "miny", "maxy")


def to_hsl(px: DataFrame) -> DataFrame:
    r, g, b = (F.col(c) / 255 for c in "rgb")
    s = px.withColumns({"top": F.greatest(r, g, b), "low": F.least(r, g, b)})
    d, total = F.col("top") - F.col("low"), F.col("top") + F.col("low")
    hue = F.when(F.col("top") == r, (g - b) / d + F.when(g < b, 6).otherwise(0)).when(F.col("top") == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    grey = d == 0
    return s.withColumns({"hue": F.when(grey, 0.0).otherwise(hue), "sat": F.when(grey, 0.0).when(total / 2 > 0.5, d / (2 - F.col("top") - F.col("low"))).otherwise(d / total), "light": total / 2}).drop("top", "low")


def from_hsl(px: DataFrame) -> DataFrame:
    sat, light = F.col("sat"), F.col("light")
    q = F.when(light < 0.5, light * (1 + sat)).otherwise(light + sat - light * sat)
    s = px.withColumns({"q": q, "p": 2 * light - q})

    def level(shift: float) -> Column:
        t = F.col("hue") + shift
        t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
        p, q = F.col("p"), F.col("q")
        v = F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)
        return 255 * F.when(sat == 0, light).otherwise(v)

    return s.withColumns({"r": level(1 / 3), "g": level(0.0), "b": level(-1 / 3)}).drop("q", "p", "hue", "sat", "light")


# The named looks.
LOOKS = {
    "none": {},
    "bw": {"grayscale": 100, "contrast": 12},
    "noir": {"grayscale": 100, "contrast": 45, "brightness": -8, "vignette": 45},
    "sepia": {"sepia": 85, "contrast": 5, "brightness": 4},
    "vintage": {"sepia": 35, "saturation": -25, "contrast": -10, "warmth": 25, "vignette": 35, "grain": 18},
    "vivid": {"saturation": 45, "contrast": 15, "sharpen": 25},
    "warm": {"warmth": 40, "saturation": 10},
    "cool": {"warmth": -40, "tint": -5},
    "fade": {"contrast": -30, "brightness": 12, "saturation": -20},
    "dramatic": {"contrast": 55, "saturation": -15, "vignette": 55, "sharpen": 20},
    "invert": {"invert": 100},
    "pop": {"saturation": 70, "contrast": 25, "exposure": 10},
}


def adjust(px: DataFrame, **fx: float) -> DataFrame:
    """Exposure, brightness, contrast, warmth and tint, then hue and saturation, grey, sepia,
    inversion, vignette and grain, in this order; parameters from -100 to 100 (hue 180)."""
    fx = {k: v for k, v in fx.items() if v and k != "sharpen"}
    if not fx:
        return px

    def of(name: str) -> float:
        return fx.get(name, 0)

    contrast = of("contrast") / 100
    factor = 1 + contrast * 2 if contrast >= 0 else 1 + contrast
    shift = {"r": of("warmth") * 0.5, "g": of("tint") * 0.4, "b": -of("warmth") * 0.5}

    def tone(c: str) -> Column:
        v = F.col(c) * 2.0 ** (of("exposure") / 50) + of("brightness") * 1.6
        return F.least(F.greatest((v - 128) * factor + 128 + shift[c], F.lit(0.0)), F.lit(255.0))

    out = sized(px).withColumns({c: tone(c) for c in "rgb"})
    sat, hue = of("saturation") / 100, of("hue") / 360
    if sat or hue:
        s = F.col("sat")
        more = s + (1 - s) * sat * s * 1.5 + s * sat * 0.3 if sat > 0 else s * (1 + sat)
        out = from_hsl(to_hsl(out).withColumns({"hue": F.pmod(F.col("hue") + hue + 1, F.lit(1.0)), "sat": F.least(F.lit(1.0), F.greatest(F.lit(0.0), more))}))
    if of("grayscale"):
        out = each(out.withColumn("l", luma()), lambda v: v + (F.col("l") - v) * (of("grayscale") / 100)).drop("l")
    if of("sepia"):
        rows = {"r": (0.393, 0.769, 0.189), "g": (0.349, 0.686, 0.168), "b": (0.272, 0.534, 0.131)}
        out = out.withColumns({c: F.col(c) + (m[0] * F.col("r") + m[1] * F.col("g") + m[2] * F.col("b") - F.col(c)) * (of("sepia") / 100) for c, m in rows.items()})
    if of("invert"):
        out = each(out, lambda v: v + (255 - 2 * v) * (of("invert") / 100))
    if of("vignette"):
        cx, cy = F.col("width") / 2, F.col("height") / 2
        far = F.sqrt((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)) / F.sqrt(cx * cx + cy * cy)
        dim = 1 - of("vignette") / 100 * F.greatest(F.lit(0.0), far - 0.35) * 1.4
        out = each(out.withColumn("dim", dim), lambda v: v * F.col("dim")).drop("dim")
    out = each(out, clamp8).drop("width", "height")
    return noise(out, of("grain") * 0.6) if of("grain") else out


def preset_look(px: DataFrame, name: str) -> DataFrame:
    look = LOOKS[name]
    out = adjust(px, **look)
    return sharpen(out, look["sharpen"] / 100) if look.get("sharpen") else out


def box_pass(px: DataFrame, radius: int, names: str, order) -> DataFrame:
    """Sums of 2 r + 1 neighbours along a row or column; the edge repeats beyond itself."""
    near = order.rowsBetween(-radius, radius)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(F.lit(0), radius + 1 - F.row_number().over(order))
    after = F.greatest(F.lit(0), radius - (F.count("*").over(whole) - F.row_number().over(order)))
    return px.withColumns({c: F.sum(c).over(near) + before * F.first(c).over(whole) + after * F.last(c).over(whole) for c in names})


def box_sums(px: DataFrame, radius: int, passes: int, names: str) -> DataFrame:
    out = each(px.repartition("image_id"), lambda v: v.cast("long"), names)
    for _ in range(passes):
        out = box_pass(box_pass(out, radius, names, by_row()), radius, names, by_column())
    return out


def blur(px: DataFrame, radius: int) -> DataFrame:
    """Three box passes each way; whole numbers until the one division at the end."""
    if radius < 1:
        return px
    return each(box_sums(px, radius, 3, "rgba"), lambda v: clamp8(v / (2 * radius + 1) ** 6), "rgba")


def sharpen(px: DataFrame, amount: float) -> DataFrame:
    soft = blur(px, 1).select(*KEY, *[F.col(c).alias(f"{c}_soft") for c in "rgb"])
    return px.join(soft, KEY).withColumns({c: clamp8(F.col(c) + (F.col(c) - F.col(f"{c}_soft")) * amount * 1.5) for c in "rgb"}).drop(*[f"{c}_soft" for c in "rgb"])


def key_alpha(color, tolerance: float, feather: float) -> tuple[Column, Column, Column]:
    """Share of alpha that stays, whether a pixel is keyed, and whether it is in the feather band."""
    tol, band = tolerance / 100 * 442, max(1.0, feather / 100 * 120)
    d = F.sqrt(sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("rgb", color)), F.lit(0)))
    return F.when(d <= tol, 0.0).when(d >= tol + band, 1.0).otherwise((d - tol) / band), d <= tol, d <= tol + band


def key_out(px: DataFrame, color=(255, 255, 255), tolerance: float = 25, feather: float = 20) -> DataFrame:
    return px.withColumn("a", clamp8(F.col("a") * key_alpha(color, tolerance, feather)[0]))


def key_out_connected(px: DataFrame, color=(255, 255, 255), tolerance: float = 25, feather: float = 20) -> DataFrame:
    """As ``key_out``, but only from the border inwards; the feather band is softened, not crossed."""
    share, keyed, banded = key_alpha(color, tolerance, feather)
    marked = written(sized(px).withColumns({"share": share, "keyed": keyed, "banded": banded}), "keyed")
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("width") - 1) | (F.col("y") == F.col("height") - 1)
    inside = reached_runs(marked.where(edge).select(*KEY), marked.where("keyed").select(*KEY))
    # a run reaches a pixel further at its ends and as wide in the rows above and below
    steps = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x0") - dx).alias("x0"), (F.col("x1") + dx).alias("x1")) for dx, dy in ((1, 0), (0, -1), (0, 1))])
    touched = pixels_of(inside.select("image_id", F.explode(steps).alias("s")).select("image_id", "s.*")).distinct().withColumn("touched", F.lit(True))
    out = marked.join(touched, KEY, "left")
    return out.withColumn("a", F.when((F.col("touched") | edge) & F.col("banded"), clamp8(F.col("a") * F.col("share"))).otherwise(F.col("a"))).select(*KEY, *"rgba")


def guess_background(px: DataFrame) -> DataFrame:
    """The colour of eight border points that most of them come near to; the first of equals."""
    s = sized(px)
    w, h, x, y = (F.col(c) for c in ("width", "height", "x", "y"))
    mw, mh = F.floor(w / 2), F.floor(h / 2)
    points = [(F.lit(0), F.lit(0)), (w - 1, F.lit(0)), (F.lit(0), h - 1), (w - 1, h - 1), (mw, F.lit(0)), (F.lit(0), mh), (w - 1, mh), (mw, h - 1)]
    at = F.array_compact(F.array(*[F.when((x == px_) & (y == py_), F.lit(i)) for i, (px_, py_) in enumerate(points)]))
    eight = s.select("image_id", F.explode(at).alias("n"), *"rgb").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("n", *"rgb"))).alias("p"))

    def near(a, b):
        return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "rgb"), F.lit(0))) < 40

    votes = F.transform("p", lambda a: F.struct(F.size(F.filter("p", lambda b: near(a, b))).alias("votes"), (-a["n"]).alias("first"), a["r"].alias("r"), a["g"].alias("g"), a["b"].alias("b")))
    return eight.select("image_id", F.array_max(votes).alias("best")).select("image_id", "best.r", "best.g", "best.b")


def gathered(px: DataFrame, names: str = "rgb") -> DataFrame:
    """Each pixel with the array ``near`` of its 3 x 3 neighbours' channels, row by row; the edge
    repeats.  Two windows on rows dealt by image."""
    cell = F.struct(*[F.col(c) for c in names])
    rows = px.repartition("image_id").withColumn("__cell", cell)
    row = rows.withColumn("__row", F.array(F.coalesce(F.lag("__cell").over(by_row()), "__cell"), F.col("__cell"), F.coalesce(F.lead("__cell").over(by_row()), "__cell")))
    return row.withColumn("near", F.concat(F.coalesce(F.lag("__row").over(by_column()), "__row"), F.col("__row"), F.coalesce(F.lead("__row").over(by_column()), "__row"))).drop("__cell", "__row")


def weighted(kernel, c: str) -> Column:
    return sum((F.get("near", F.lit(i))[c] * k for i, k in enumerate(kernel) if k), F.lit(0))


# The emboss kernel.
EMBOSS = (-2, -1, 0, -1, 1, 1, 0, 1, 2)


def convolve(px: DataFrame, kernel, bias: float = 0, divisor: float = 1) -> DataFrame:
    near = gathered(px)
    return near.withColumns({c: clamp8(weighted(kernel, c) / divisor + bias) for c in "rgb"}).drop("near")


def edges(px: DataFrame, inverted: bool = False) -> DataFrame:
    """Sobel magnitude of the luma, a quarter, at most 255; inverted for the look of a sketch."""
    grey = px.withColumn("l", clamp8(luma()))
    near = gathered(grey, "l")
    gx, gy = weighted((-1, 0, 1, -2, 0, 2, -1, 0, 1), "l"), weighted((-1, -2, -1, 0, 0, 0, 1, 2, 1), "l")
    v = clamp8(F.least(F.lit(255.0), F.sqrt(gx * gx + gy * gy) / 4))
    return near.withColumn("v", v).withColumns({c: 255 - F.col("v") if inverted else F.col("v") for c in "rgb"}).drop("v", "l", "near")


def denoise(px: DataFrame) -> DataFrame:
    """3 x 3 median of each channel."""
    near = gathered(px)
    return near.withColumns({c: F.get(F.array_sort(F.transform("near", lambda n: n[c])), F.lit(4)) for c in "rgb"}).drop("near")


def pixelate(px: DataFrame, n: int) -> DataFrame:
    block = Window.partitionBy("image_id", F.floor(F.col("x") / n), F.floor(F.col("y") / n))
    return px.withColumns({c: half_up(F.avg(c).over(block)).cast("int") for c in "rgba"})


def posterize(px: DataFrame, levels: int) -> DataFrame:
    n = max(2, levels) - 1
    return each(px, lambda v: half_up(half_up(v / 255 * n) * (255 / n)).cast("int"))


def threshold(px: DataFrame, level: float) -> DataFrame:
    return px.withColumn("v", F.when(luma() >= level, 255).otherwise(0)).withColumns({c: F.col("v") for c in "rgb"}).drop("v")


def histogram(px: DataFrame) -> DataFrame:
    """(image_id, channel, value, n)."""
    levels = px.select("image_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in "rgb"])).alias("s"))
    return levels.groupBy("image_id", "s.channel", "s.value").agg(F.count("*").alias("n"))


def auto_levels(px: DataFrame) -> DataFrame:
    """Each channel stretched between the first levels past half a percent from either end."""
    by = Window.partitionBy("image_id", "channel")
    h = histogram(px).withColumns({"total": F.sum("n").over(by), "up": F.sum("n").over(by.orderBy("value")), "down": F.sum("n").over(by.orderBy(F.desc("value")))})
    cut = F.col("total") * 0.005
    ends = h.groupBy("image_id", "channel").agg(F.min(F.when(F.col("up") > cut, F.col("value"))).alias("lo"), F.max(F.when(F.col("down") > cut, F.col("value"))).alias("hi"))
    wide = ends.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("lo", "hi")))).alias("ends"))

    def stretch(c: str) -> Column:
        e = F.element_at("ends", c)
        return F.when(e["hi"] <= e["lo"], F.col(c)).otherwise(clamp8((F.col(c) - e["lo"]) * 255 / (e["hi"] - e["lo"])))

    return px.join(wide, "image_id").withColumns({c: stretch(c) for c in "rgb"}).drop("ends")


def noise(px: DataFrame, amount: float, seed: int = 1) -> DataFrame:
    """The same shift for a pixel's channels, from whole-number arithmetic on (seed, x, y)."""
    h = (F.col("x").cast("long") * 73856093 + F.col("y").cast("long") * 19349663 + F.lit(seed) * 83492791) % 65536
    h = (h * h * 31 + h * 17 + 7) % 65521
    shift = (h / 65520.0 - 0.5) * 2 * amount
    return px.withColumn("shift", shift).withColumns({c: clamp8(F.col(c) + F.col("shift")) for c in "rgb"}).drop("shift")


# The names of the blend modes and the weights of luminosity.
BLEND_MODES = (
    "normal", "multiply", "screen", "overlay", "darken", "lighten", "color-dodge", "color-burn", "hard-light", "soft-light",
    "difference", "exclusion", "hue", "saturation", "color", "luminosity",
)
LUMINOSITY = (0.3, 0.59, 0.11)


def separable(s: Column, d: Column) -> dict[str, Column]:
    """Each mode that treats a channel by itself: source s over backdrop d, both from 0 to 1."""
    one, half = F.lit(1.0), F.lit(0.5)
    light = lambda top, under: F.when(top <= half, under * 2 * top).otherwise(under + (2 * top - 1) - under * (2 * top - 1))
    curve = F.when(d <= 0.25, ((16 * d - 12) * d + 4) * d).otherwise(F.sqrt(d))
    return {
        "multiply": s * d,
        "screen": s + d - s * d,
        "overlay": light(d, s),
        "darken": F.least(s, d),
        "lighten": F.greatest(s, d),
        "color-dodge": F.when(d == 0, 0.0).when(s >= 1, 1.0).otherwise(F.least(one, F.try_divide(d, 1 - s))),
        "color-burn": F.when(d >= 1, 1.0).when(s == 0, 0.0).otherwise(1 - F.least(one, F.try_divide(1 - d, s))),
        "hard-light": light(s, d),
        "soft-light": F.when(s <= half, d - (1 - 2 * s) * d * (1 - d)).otherwise(d + (2 * s - 1) * (curve - d)),
        "difference": F.abs(s - d),
        "exclusion": s + d - 2 * s * d,
    }


def luminosity(c: list[Column]) -> Column:
    return c[0] * LUMINOSITY[0] + c[1] * LUMINOSITY[1] + c[2] * LUMINOSITY[2]


def bound(values: dict[str, Column], then) -> Column:
    """``then`` of a struct of values that are computed once, however often it names them."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), F.lit(0))


def whole_colour(v: Column) -> Column:
    """(r, g, b) of the modes that mix hue, saturation and luminosity of source and backdrop: a colour
    stretched to a saturation from zero up, moved to a luminosity and drawn towards grey until it fits."""
    s, d = [v[f"s{c}"] for c in "rgb"], [v[f"d{c}"] for c in "rgb"]
    ends = {"s_low": F.least(*s), "s_high": F.greatest(*s), "d_low": F.least(*d), "d_high": F.greatest(*d), "light": F.when(v["mode"] == "luminosity", luminosity(s)).otherwise(luminosity(d))}

    def stretched(e: Column) -> Column:
        def to(x: Column, low: Column, high: Column, by: Column) -> Column:
            return F.when(high > low, F.try_divide((x - low) * by, high - low)).otherwise(F.lit(0.0))

        def of(k: int) -> Column:
            hue, saturation = to(s[k], e["s_low"], e["s_high"], e["d_high"] - e["d_low"]), to(d[k], e["d_low"], e["d_high"], e["s_high"] - e["s_low"])
            return F.when(v["mode"] == "hue", hue).when(v["mode"] == "saturation", saturation).when(v["mode"] == "color", s[k]).otherwise(d[k])

        return bound({c: of(k) for k, c in enumerate("rgb")} | {"light": e["light"]}, moved)

    def moved(t: Column) -> Column:
        by = lambda m: {c: t[c] + m["by"] for c in "rgb"}
        return bound({"by": t["light"] - luminosity([t[c] for c in "rgb"])}, lambda m: bound(by(m), fitted))

    def fitted(u: Column) -> Column:
        c = [u[k] for k in "rgb"]

        def held(e: Column) -> Column:
            raised = {k: F.when(e["low"] < 0, e["grey"] + F.try_divide((u[k] - e["grey"]) * e["grey"], e["grey"] - e["low"])).otherwise(u[k]) for k in "rgb"}
            return bound(raised, lambda r: F.struct(*[F.when(e["high"] > 1, e["grey"] + F.try_divide((r[k] - e["grey"]) * (1 - e["grey"]), e["high"] - e["grey"])).otherwise(r[k]).alias(k) for k in "rgb"]))

        return bound({"grey": luminosity(c), "low": F.least(*c), "high": F.greatest(*c)}, held)

    return bound(ends, stretched)


def composite(layers: DataFrame) -> DataFrame:
    """Layers (image_id, z, opacity, blend, hidden, pixels) from the bottom up, by the W3C formulas
    of the sixteen ``BLEND_MODES``; another name is an error.  A step's values are bound once, and the
    mode is chosen once for a pixel."""
    rows = layers.where(~F.col("hidden")).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("z", "opacity", "blend", *"rgba"))).alias("stack"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "rgba"])

    def step(acc: Column, s: Column) -> Column:
        given = {"sa": s["a"] / 255 * s["opacity"], "da": acc["a"], "mode": s["blend"]}
        given |= {f"s{c}": s[c] / 255 for c in "rgb"} | {f"d{c}": acc[c] for c in "rgb"}
        return bound(given, blended)

    def blended(v: Column) -> Column:
        made = {c: separable(v[f"s{c}"], v[f"d{c}"]) for c in "rgb"}
        unknown = F.raise_error(F.concat(F.lit("unknown blend mode: "), F.coalesce(v["mode"], F.lit("null")))).cast("double")
        colour = lambda of: F.struct(*[of(c).cast("double").alias(c) for c in "rgb"])
        chosen = F.when(v["mode"] == "normal", colour(lambda c: v[f"s{c}"]))
        for name in made["r"]:
            chosen = chosen.when(v["mode"] == name, colour(lambda c, name=name: made[c][name]))
        chosen = chosen.when(v["mode"].isin("hue", "saturation", "color", "luminosity"), whole_colour(v)).otherwise(colour(lambda c: unknown))

        def over(m: Column) -> Column:
            sa, da, oa = v["sa"], v["da"], m["oa"]
            mixed = lambda c: F.when(oa > 0, (sa * ((1 - da) * v[f"s{c}"] + da * m["b"][c]) + (1 - sa) * da * v[f"d{c}"]) / oa).otherwise(F.lit(0.0))
            return F.struct(*[mixed(c).alias(c) for c in "rgb"], oa.alias("a"))

        return bound({"b": chosen, "oa": v["sa"] + v["da"] * (1 - v["sa"])}, over)

    done = rows.select(*KEY, F.aggregate("stack", zero, step).alias("o"))
    return done.select(*KEY, *[clamp8(F.col(f"o.{c}") * 255).alias(c) for c in "rgba"])


def corner_offsets(radius: Column, shift: float) -> tuple[Column, Column]:
    """How far a pixel lies into a corner's square on both axes; 0 outside of it."""
    def into(at: str, size: str) -> Column:
        far = F.col(size) - radius
        return F.when(F.col(at) < radius, radius - F.col(at) - shift).when(F.col(at) >= far, F.col(at) - far + (1 - shift)).otherwise(0.0)

    return into("x", "width"), into("y", "height")


def round_corners(px: DataFrame, radius: float) -> DataFrame:
    """Alpha falls to nothing outside of rounded corners; the edge is one pixel wide."""
    r = F.least(F.lit(float(radius)), F.col("width") / 2, F.col("height") / 2)
    dx, dy = corner_offsets(r, 0.5)
    over = F.sqrt(dx * dx + dy * dy) - r
    cut = (r >= 1) & (dx != 0) & (dy != 0) & (over > -1)
    a = F.when(cut, clamp8(F.col("a") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), -over)))).otherwise(F.col("a"))
    return sized(px).withColumn("a", a).select(*KEY, *"rgba")


def border(px: DataFrame, width: float, color=(0, 0, 0), radius: float = 0) -> DataFrame:
    """A border of a colour inside the edges, along rounded corners too."""
    b = max(0, math.floor(width + 0.5))
    r = F.least(F.lit(float(radius)), F.col("width") / 2, F.col("height") / 2)
    dx, dy = corner_offsets(r, 0.0)
    straight = F.least("x", "y", F.col("width") - 1 - F.col("x"), F.col("height") - 1 - F.col("y")).cast("double")
    edge = F.when((r >= 1) & (dx != 0) & (dy != 0), r - F.sqrt(dx * dx + dy * dy)).otherwise(straight)
    share = F.when(edge < b, F.least(F.lit(1.0), b - edge)).otherwise(0.0)
    made = sized(px).withColumn("share", share)
    return made.select(*KEY, *[clamp8(F.col(c) + (v - F.col(c)) * F.col("share")).alias(c) for c, v in zip("rgb", color)], "a")


def drop_shadow(px: DataFrame, radius: float, dx: float, dy: float, color=(0, 0, 0), opacity: float = 50) -> DataFrame:
    """The image over a blurred shadow of its alpha, on a larger canvas."""
    pad = math.ceil(radius * 2 + max(abs(dx), abs(dy)))
    right, down = math.floor(dx + 0.5), math.floor(dy + 0.5)
    dims = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    canvas = dims.select("image_id", F.explode(F.sequence(F.lit(0), F.col("w") + 2 * pad - 1)).alias("x"), "h")
    canvas = canvas.select("image_id", "x", F.explode(F.sequence(F.lit(0), F.col("h") + 2 * pad - 1)).alias("y"))
    cast = px.select("image_id", (F.col("x") + pad + right).alias("x"), (F.col("y") + pad + down).alias("y"), clamp8(F.col("a") * (opacity / 100)).alias("sa"))
    held = canvas.join(cast, KEY, "left")
    inked = [F.when(F.col("sa").isNotNull(), v).otherwise(0).alias(c) for c, v in zip("rgb", color)]
    shadow = blur(held.select(*KEY, *inked, F.coalesce("sa", F.lit(0)).alias("a")), radius)
    top = px.select("image_id", (F.col("x") + pad).alias("x"), (F.col("y") + pad).alias("y"), *[F.col(c).alias(f"top_{c}") for c in "rgba"])
    both = shadow.join(top, KEY, "left")
    sa, da = F.coalesce("top_a", F.lit(0)) / 255, F.col("a") / 255
    oa = sa + da * (1 - sa)
    mixed = [F.when(oa > 0, clamp8(F.try_divide(F.coalesce(f"top_{c}", F.lit(0)) * sa + F.col(c) * da * (1 - sa), oa))).otherwise(F.col(c)).alias(c) for c in "rgb"]
    return both.select(*KEY, *mixed, clamp8(oa * 255).alias("a"))


def apply_alpha(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Alpha times a plane (image_id, x, y, m) of another size, nearest sample."""
    m = mask.withColumns({"mw": F.max("x").over(by_image()) + 1, "mh": F.max("y").over(by_image()) + 1}).select("image_id", F.col("x").alias("mx"), F.col("y").alias("my"), "m")
    dims = mask.groupBy("image_id").agg((F.max("x") + 1).alias("mw"), (F.max("y") + 1).alias("mh"))
    at = sized(px).join(dims, "image_id").withColumns({"mx": F.floor(F.col("x") * F.col("mw") / F.col("width")).cast("int"), "my": F.floor(F.col("y") * F.col("mh") / F.col("height")).cast("int")})
    return at.join(m, ["image_id", "mx", "my"]).withColumn("a", half_up(F.col("a") * F.col("m") / 255).cast("int")).select(*KEY, *"rgba")


def cmyk_to_rgb(df: DataFrame) -> DataFrame:
    """Samples c, m, y2, k from 0 to 1."""
    return df.withColumns({o: clamp8((1 - F.col(i)) * (1 - F.col("k")) * 255) for o, i in zip("rgb", ("c", "m", "y2"))})


def lab_to_rgb(df: DataFrame) -> DataFrame:
    """CIE L*a*b* (columns cl, ca, cb; D65) to sRGB."""
    def f(t: Column) -> Column:
        return F.when(t * t * t > 0.008856, t * t * t).otherwise((t - 16 / 116) / 7.787)

    def g(c: Column) -> Column:
        return F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c)

    fy = (F.col("cl") + 16) / 116
    s = df.withColumns({"lx": 0.95047 * f(F.col("ca") / 500 + fy), "ly": f(fy), "lz": 1.08883 * f(fy - F.col("cb") / 200)})
    rows = {"r": (3.2406, -1.5372, -0.4986), "g": (-0.9689, 1.8758, 0.0415), "b": (0.0557, -0.204, 1.057)}
    return s.withColumns({c: clamp8(g(F.col("lx") * m[0] + F.col("ly") * m[1] + F.col("lz") * m[2]) * 255) for c, m in rows.items()}).drop("lx", "ly", "lz")


def palette_to_rgb(df: DataFrame, palette: DataFrame) -> DataFrame:
    """Indexed samples through a palette of 256 entries at most, which is broadcast."""
    return df.join(F.broadcast(palette), "idx")


def range_mask(px: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Alpha 0 where every sample is in its range."""
    inside = F.lit(True)
    for c, (low, high) in ranges.items():
        inside = inside & F.col(c).between(low, high)
    return px.withColumn("a", F.when(inside, 0).otherwise(F.col("a")))


def undelta(px: DataFrame, how: str) -> DataFrame:
    """Undoes differences to the left or the upper neighbour, modulo 256."""
    order = (by_row() if how == "left" else by_column()).rowsBetween(Window.unboundedPreceding, 0)
    return px.withColumns({c: F.pmod(F.sum(c).over(order), F.lit(256)).cast("int") for c in "rgb"})
