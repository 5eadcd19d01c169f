"""Queries of pixel tables and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import masks as mk
from folio.operators import raster as ra
from folio.plans.registry import query


def clamp(v: str) -> str:
    return f"CAST(round_even(least(greatest(CAST({v} AS DOUBLE), 0), 255), 0) AS INT)"


def rounded(v: str) -> str:
    return f"CAST(floor(CAST({v} AS DOUBLE) + 0.5) AS INT)"


def rgb(f, names: str = "rgb") -> str:
    return ", ".join(f"{f(c)} AS {c}" for c in names)


def near_sql(src: str, names: str = "rgb") -> str:
    rows = ", ".join(f"coalesce(lag({c}) OVER h, {c}) AS {c}l, coalesce(lead({c}) OVER h, {c}) AS {c}r" for c in names)
    cols = []
    for c in names:
        for j, f in enumerate(("coalesce(lag({v}) OVER v, {v})", "{v}", "coalesce(lead({v}) OVER v, {v})")):
            cols += [f"{f.format(v=v)} AS {c}{3 * j + i}" for i, v in enumerate((f"{c}l", c, f"{c}r"))]
    return f"(SELECT *, {', '.join(cols)} FROM (SELECT *, {rows} FROM {src} WINDOW h AS (PARTITION BY image_id, y ORDER BY x)) WINDOW v AS (PARTITION BY image_id, x ORDER BY y))"


def blur_sql(src: str, passes: int, names: str) -> str:
    for _ in range(passes):
        for part, by in (("y", "x"), ("x", "y")):
            sums = ", ".join(f"CAST(coalesce(lag({c}) OVER w, {c}) + {c} + coalesce(lead({c}) OVER w, {c}) AS BIGINT) AS {c}" for c in names)
            src = f"(SELECT image_id, x, y, {sums} FROM {src} WINDOW w AS (PARTITION BY image_id, {part} ORDER BY {by}))"
    return src


@query("px_crop", "SELECT image_id, x - 2 AS x, y - 1 AS y, r, g, b, a FROM fx_pixels WHERE x >= 2 AND x < 7 AND y >= 1 AND y < 5", "fx_pixels")
def px_crop(t):
    return ra.crop_px(t.fx_pixels, 1.6, 0.7, 5.2, 3.9)


@query("px_flip", "SELECT image_id, 7 - x AS x, y, r, g, b, a FROM fx_pixels", "fx_pixels")
def px_flip(t):
    return ra.flip_px(t.fx_pixels, True)


@query("px_turn", "SELECT image_id, 7 - y AS x, x AS y, r, g, b, a FROM fx_pixels", "fx_pixels")
def px_turn(t):
    return ra.turn_px(t.fx_pixels)


@query("px_canvas", f"""
SELECT g.image_id, g.x, g.y, {', '.join(f'coalesce(p.{c}, 0) AS {c}' for c in 'rgba')} FROM (SELECT DISTINCT image_id, CAST(i % 10 AS INT) AS x, CAST(i // 10 AS INT) AS y FROM fx_pixels, range(60) t(i)) g
LEFT JOIN fx_pixels p ON g.image_id = p.image_id AND p.x + 1 = g.x AND p.y - 1 = g.y""", "fx_pixels")  # fmt: skip
def px_canvas(t):
    return ra.resize_canvas(t.fx_pixels, 10, 6)


@query("px_resize", f"SELECT image_id, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, {rgb(lambda c: clamp(f'avg({c})'), 'rgba')} FROM fx_pixels GROUP BY image_id, x // 2, y // 2", "fx_pixels")
def px_resize(t):
    return ra.resize_px(t.fx_pixels, 4, 4)


HOLES_SQL = "SELECT image_id, x, y, r, g, b, CASE WHEN x < image_id % 3 OR y > 7 - image_id % 2 OR image_id % 50 = 0 THEN 0 ELSE a END AS a FROM fx_pixels"


@query("px_trim", f"""
SELECT image_id, x - coalesce(x0, 0) AS x, y - coalesce(y0, 0) AS y, r, g, b, a FROM (SELECT *, min(CASE WHEN a > 8 THEN x END) OVER w AS x0, max(CASE WHEN a > 8 THEN x END) OVER w AS x1, min(CASE WHEN a > 8 THEN y END) OVER w AS y0, max(CASE WHEN a > 8 THEN y END) OVER w AS y1
FROM ({HOLES_SQL}) WINDOW w AS (PARTITION BY image_id)) WHERE x0 IS NULL OR (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)""", "fx_pixels")  # fmt: skip
def px_trim(t):
    return ra.trim_px(t.sql(HOLES_SQL))


@query("px_adjust", f"""
WITH t AS (SELECT image_id, x, y, a, {', '.join(f"least(greatest(({c} * pow(2.0::DOUBLE, 0.4) + 16 - 128) * 1.3::DOUBLE + 128 + {s}, 0.0::DOUBLE), 255.0::DOUBLE) AS {c}" for c, s in zip('rgb', (10, 4, -10)))} FROM fx_pixels),
l AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM t), q AS (SELECT image_id, x, y, a, {', '.join(f"{c} + (l - {c}) * 0.5::DOUBLE AS {c}" for c in 'rgb')} FROM l),
s AS (SELECT image_id, x, y, a, r + (0.393::DOUBLE * r + 0.769::DOUBLE * g + 0.189::DOUBLE * b - r) * 0.25::DOUBLE AS r, g + (0.349::DOUBLE * r + 0.686::DOUBLE * g + 0.168::DOUBLE * b - g) * 0.25::DOUBLE AS g, b + (0.272::DOUBLE * r + 0.534::DOUBLE * g + 0.131::DOUBLE * b - b) * 0.25::DOUBLE AS b FROM q)
SELECT image_id, x, y, {', '.join(f"{clamp(f'({c} + (255 - 2 * {c}) * 0.1::DOUBLE) * (1 - 0.4::DOUBLE * greatest(0.0::DOUBLE, sqrt((x - 4.0::DOUBLE) * (x - 4.0::DOUBLE) + (y - 4.0::DOUBLE) * (y - 4.0::DOUBLE)) / sqrt(32.0::DOUBLE) - 0.35::DOUBLE) * 1.4::DOUBLE)')} AS {c}" for c in 'rgb')}, a FROM s""", "fx_pixels")  # fmt: skip
def px_adjust(t):
    return ra.adjust(t.fx_pixels, exposure=20, brightness=10, contrast=15, warmth=20, tint=10, grayscale=50, sepia=25, invert=10, vignette=40)


@query("px_preset", f"SELECT image_id, x, y, {rgb(lambda c: clamp(f'255 - {c}'))}, a FROM fx_pixels", "fx_pixels")
def px_preset(t):
    return ra.preset_look(t.fx_pixels, "invert")


def level_sql(shift: str) -> str:
    t = f"(CASE WHEN hue + {shift} < 0 THEN hue + {shift} + 1 WHEN hue + {shift} > 1 THEN hue + {shift} - 1 ELSE hue + {shift} END)"
    return f"CASE WHEN {t} < 1 / 6::DOUBLE THEN p + (q - p) * 6 * {t} WHEN {t} < 0.5 THEN q WHEN {t} < 2 / 3::DOUBLE THEN p + (q - p) * (2 / 3::DOUBLE - {t}) * 6 ELSE p END"


VIVID_SQL = f"""(SELECT image_id, x, y, {', '.join(f"{clamp(f'255 * CASE WHEN sat = 0 THEN light ELSE {level_sql(s)} END')} AS {c}" for c, s in zip('rgb', ('1 / 3::DOUBLE', '0', '(-1 / 3::DOUBLE)')))}, a FROM (
SELECT *, 2 * light - q AS p FROM (SELECT *, CASE WHEN light < 0.5 THEN light * (1 + sat) ELSE light + sat - light * sat END AS q FROM (
SELECT * REPLACE ((hue + 1) % 1 AS hue, least(1.0::DOUBLE, sat + (1 - sat) * 0.45::DOUBLE * sat * 1.5 + sat * 0.45::DOUBLE * 0.3) AS sat) FROM (
SELECT *, (hi + lo) / 2 AS light, CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS sat,
CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END / 6 AS hue FROM (
SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM (
SELECT image_id, x, y, a, {', '.join(f"least(greatest(({c} - 128) * 1.3::DOUBLE + 128, 0.0::DOUBLE), 255.0::DOUBLE) / 255 AS {c}" for c in 'rgb')} FROM fx_pixels)))))))"""
SOFT_SQL = f"SELECT image_id, x, y, {rgb(lambda c: clamp(f'{c} / 729.0::DOUBLE'))} FROM {blur_sql('v', 3, 'rgba')}"


@query("px_preset_vivid", f"WITH v AS {VIVID_SQL} SELECT v.image_id, v.x, v.y, {', '.join(f'{clamp(f'v.{c} + (v.{c} - s.{c}) * 0.25::DOUBLE * 1.5')} AS {c}' for c in 'rgb')}, v.a FROM v JOIN ({SOFT_SQL}) s ON v.image_id = s.image_id AND v.x = s.x AND v.y = s.y", "fx_pixels")
def px_preset_vivid(t):
    return ra.preset_look(t.fx_pixels, "vivid")


BLURRED_SQL = f"SELECT image_id, x, y, {rgb(lambda c: clamp(f'{c} / 729.0::DOUBLE'), 'rgba')} FROM {blur_sql('fx_pixels', 3, 'rgba')}"


@query("px_blur", BLURRED_SQL, "fx_pixels")
def px_blur(t):
    return ra.blur(t.fx_pixels, 1)


@query("px_sharpen", f"SELECT p.image_id, p.x, p.y, {', '.join(f'{clamp(f'p.{c} + (p.{c} - s.{c}) * 0.4::DOUBLE * 1.5')} AS {c}' for c in 'rgb')}, p.a FROM fx_pixels p JOIN ({BLURRED_SQL}) s ON p.image_id = s.image_id AND p.x = s.x AND p.y = s.y", "fx_pixels")
def px_sharpen(t):
    return ra.sharpen(t.fx_pixels, 0.4)


SHARE = "CASE WHEN d <= 110.5::DOUBLE THEN 0.0::DOUBLE WHEN d >= 110.5::DOUBLE + 24 THEN 1.0::DOUBLE ELSE (d - 110.5::DOUBLE) / 24 END"
FAR_SQL = "SELECT *, sqrt(CAST((r - 128) * (r - 128) + (g - 128) * (g - 128) + (b - 128) * (b - 128) AS DOUBLE)) AS d FROM fx_pixels"


@query("px_key_out", f"SELECT image_id, x, y, r, g, b, {clamp(f'a * {SHARE}')} AS a FROM ({FAR_SQL})", "fx_pixels")
def px_key_out(t):
    return ra.key_out(t.fx_pixels, (128, 128, 128), 25, 20)


@query("px_key_out_connected", f"""
WITH RECURSIVE f AS ({FAR_SQL}), k AS (SELECT image_id, x, y FROM f WHERE d <= 110.5::DOUBLE),
w AS (SELECT image_id, x, y FROM k WHERE x IN (0, 7) OR y IN (0, 7) UNION SELECT k.image_id, k.x, k.y FROM w JOIN k ON k.image_id = w.image_id AND abs(k.x - w.x) + abs(k.y - w.y) = 1),
s AS (SELECT DISTINCT f.image_id, f.x, f.y FROM f LEFT JOIN w ON f.image_id = w.image_id AND abs(f.x - w.x) + abs(f.y - w.y) <= 1 WHERE w.x IS NOT NULL OR f.x IN (0, 7) OR f.y IN (0, 7))
SELECT f.image_id, f.x, f.y, r, g, b, CASE WHEN s.x IS NOT NULL AND d <= 134.5::DOUBLE THEN {clamp(f'a * {SHARE}')} ELSE a END AS a FROM f LEFT JOIN s ON f.image_id = s.image_id AND f.x = s.x AND f.y = s.y""", "fx_pixels")  # fmt: skip
def px_key_out_connected(t):
    return ra.key_out_connected(t.fx_pixels, (128, 128, 128), 25, 20)


@query("px_background", """
WITH p AS (SELECT p.image_id, n, r, g, b FROM fx_pixels p JOIN (VALUES (0, 0, 0), (7, 0, 1), (0, 7, 2), (7, 7, 3), (4, 0, 4), (0, 4, 5), (7, 4, 6), (4, 7, 7)) c(cx, cy, n) ON x = cx AND y = cy),
v AS (SELECT a.image_id, a.n, a.r, a.g, a.b, sum(CASE WHEN (a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b) < 1600 THEN 1 ELSE 0 END) AS votes FROM p a JOIN p b ON a.image_id = b.image_id GROUP BY ALL)
SELECT image_id, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, n) AS k FROM v) WHERE k = 1""", "fx_pixels")  # fmt: skip
def px_background(t):
    return ra.guess_background(t.fx_pixels)


def kernel_sql(kernel, c: str) -> str:
    return " + ".join(f"({k}) * {c}{i}" for i, k in enumerate(kernel) if k)


@query("px_convolve", f"SELECT image_id, x, y, {rgb(lambda c: clamp(kernel_sql(ra.EMBOSS, c)))}, a FROM {near_sql('fx_pixels')}", "fx_pixels")
def px_convolve(t):
    return ra.convolve(t.fx_pixels, ra.EMBOSS)


LUMA = "0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b"


@query("px_edges", f"""
SELECT image_id, x, y, v AS r, v AS g, v AS b, a FROM (SELECT *, {clamp(f"least(255.0::DOUBLE, sqrt(CAST(({kernel_sql((-1, 0, 1, -2, 0, 2, -1, 0, 1), 'l')}) * ({kernel_sql((-1, 0, 1, -2, 0, 2, -1, 0, 1), 'l')}) + ({kernel_sql((-1, -2, -1, 0, 0, 0, 1, 2, 1), 'l')}) * ({kernel_sql((-1, -2, -1, 0, 0, 0, 1, 2, 1), 'l')}) AS DOUBLE)) / 4)")} AS v FROM {near_sql(f"(SELECT *, {clamp(LUMA)} AS l FROM fx_pixels)", "l")})""", "fx_pixels")  # fmt: skip
def px_edges(t):
    return ra.edges(t.fx_pixels)


@query("px_median", f"SELECT image_id, x, y, {', '.join(f'list_sort([{", ".join(f"{c}{i}" for i in range(9))}])[5] AS {c}' for c in 'rgb')}, a FROM {near_sql('fx_pixels')}", "fx_pixels")
def px_median(t):
    return ra.denoise(t.fx_pixels)


@query("px_pixelate", f"SELECT image_id, x, y, {rgb(lambda c: rounded(f'avg({c}) OVER w'), 'rgba')} FROM fx_pixels WINDOW w AS (PARTITION BY image_id, x // 3, y // 3)", "fx_pixels")
def px_pixelate(t):
    return ra.pixelate(t.fx_pixels, 3)


@query("px_posterize", f"SELECT image_id, x, y, {rgb(lambda c: rounded(f'floor({c} / 255.0::DOUBLE * 3 + 0.5) * 85.0::DOUBLE'))}, a FROM fx_pixels", "fx_pixels")
def px_posterize(t):
    return ra.posterize(t.fx_pixels, 4)


@query("px_threshold", f"SELECT image_id, x, y, v AS r, v AS g, v AS b, a FROM (SELECT *, CASE WHEN {LUMA} >= 120 THEN 255 ELSE 0 END AS v FROM fx_pixels)", "fx_pixels")
def px_threshold(t):
    return ra.threshold(t.fx_pixels, 120)


HISTOGRAM_SQL = " UNION ALL ".join(f"SELECT image_id, '{c}' AS channel, {c} AS value, count(*) AS n FROM fx_pixels GROUP BY image_id, {c}" for c in "rgb")


@query("px_histogram", HISTOGRAM_SQL, "fx_pixels")
def px_histogram(t):
    return ra.histogram(t.fx_pixels)


@query("px_auto_levels", f"SELECT image_id, x, y, {', '.join(f'CASE WHEN max({c}) OVER w <= min({c}) OVER w THEN {c} ELSE {clamp(f'({c} - min({c}) OVER w) * 255 / (max({c}) OVER w - min({c}) OVER w)')} END AS {c}' for c in 'rgb')}, a FROM fx_pixels WINDOW w AS (PARTITION BY image_id)", "fx_pixels")
def px_auto_levels(t):
    return ra.auto_levels(t.fx_pixels)


@query("px_noise", f"""
WITH h AS (SELECT *, (CAST(x AS BIGINT) * 73856093 + CAST(y AS BIGINT) * 19349663 + 3 * 83492791) % 65536 AS h FROM fx_pixels), s AS (SELECT *, (((h * h * 31 + h * 17 + 7) % 65521) / 65520.0::DOUBLE - 0.5) * 2 * 20 AS s FROM h)
SELECT image_id, x, y, {rgb(lambda c: clamp(f'{c} + s'))}, a FROM s""", "fx_pixels")  # fmt: skip
def px_noise(t):
    return ra.noise(t.fx_pixels, 20, 3)


LAYERS_SQL = """SELECT image_id, x, y, r, g, b, a, 0 AS z, CAST(1.0 AS DOUBLE) AS opacity, 'normal' AS blend, FALSE AS hidden FROM fx_pixels
UNION ALL SELECT image_id, x, y, b, r, g, CASE WHEN x > 3 THEN 128 ELSE 255 END, 1, CAST(0.5 AS DOUBLE), CASE WHEN image_id % 2 = 0 THEN 'multiply' ELSE 'screen' END, FALSE FROM fx_pixels
UNION ALL SELECT image_id, x, y, 9, 9, 9, 255, 2, CAST(1.0 AS DOUBLE), 'normal', TRUE FROM fx_pixels"""


@query("px_composite", f"""
SELECT p.image_id, p.x, p.y, {', '.join(f"{clamp(f'(sa * (CASE WHEN p.image_id % 2 = 0 THEN q.{c} / 255.0::DOUBLE * (p.{c} / 255.0::DOUBLE) ELSE q.{c} / 255.0::DOUBLE + p.{c} / 255.0::DOUBLE - q.{c} / 255.0::DOUBLE * (p.{c} / 255.0::DOUBLE) END) + (1 - sa) * (p.{c} / 255.0::DOUBLE)) * 255')} AS {c}" for c in 'rgb')}, 255 AS a
FROM fx_pixels p JOIN (SELECT image_id, x, y, b AS r, r AS g, g AS b, CASE WHEN x > 3 THEN 128 ELSE 255 END / 255.0::DOUBLE * 0.5 AS sa FROM fx_pixels) q ON p.image_id = q.image_id AND p.x = q.x AND p.y = q.y""", "fx_pixels")  # fmt: skip
def px_composite(t):
    return ra.composite(t.sql(LAYERS_SQL))


MODES = ra.BLEND_MODES
BLEND_SQL = f"SELECT image_id, x, y, r, g, b, 255 AS a, 0 AS z, CAST(1.0 AS DOUBLE) AS opacity, 'normal' AS blend, FALSE AS hidden FROM fx_pixels UNION ALL SELECT image_id, x, y, b, r, g, 255, 1, CAST(1.0 AS DOUBLE), CASE image_id % 16 {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODES))} END, FALSE FROM fx_pixels"
ONE_SQL = {
    "normal": "{s}", "multiply": "{s} * {d}", "screen": "{s} + {d} - {s} * {d}", "darken": "least({s}, {d})", "lighten": "greatest({s}, {d})", "difference": "abs({s} - {d})", "exclusion": "{s} + {d} - 2 * {s} * {d}",
    "overlay": "CASE WHEN {d} <= 0.5::DOUBLE THEN {s} * 2 * {d} ELSE {s} + (2 * {d} - 1) - {s} * (2 * {d} - 1) END", "hard-light": "CASE WHEN {s} <= 0.5::DOUBLE THEN {d} * 2 * {s} ELSE {d} + (2 * {s} - 1) - {d} * (2 * {s} - 1) END",
    "color-dodge": "CASE WHEN {d} = 0 THEN 0 WHEN {s} >= 1 THEN 1 ELSE least(1, {d} / (1 - {s})) END", "color-burn": "CASE WHEN {d} >= 1 THEN 1 WHEN {s} = 0 THEN 0 ELSE 1 - least(1, (1 - {d}) / {s}) END",
    "soft-light": "CASE WHEN {s} <= 0.5::DOUBLE THEN {d} - (1 - 2 * {s}) * {d} * (1 - {d}) ELSE {d} + (2 * {s} - 1) * (CASE WHEN {d} <= 0.25::DOUBLE THEN ((16 * {d} - 12) * {d} + 4) * {d} ELSE sqrt({d}) END - {d}) END",
    "hue": "m{c}", "saturation": "m{c}", "color": "m{c}", "luminosity": "m{c}",
}


def lum_sql(*c):
    return f"({c[0]} * 0.3::DOUBLE + {c[1]} * 0.59::DOUBLE + {c[2]} * 0.11::DOUBLE)"


def stretched_sql(c, by):
    """Channel ``c`` of the stretched colour, before its luminosity is set, for each mode of whole colours."""
    def sat(k, of):
        low, high = (f"{f}({', '.join(of + x for x in 'rgb')})" for f in ("least", "greatest"))
        return f"CASE WHEN {high} > {low} THEN ({of}{k} - {low}) * ({by[of]}) / ({high} - {low}) ELSE 0 END"

    return f"CASE mode WHEN 'hue' THEN {sat(c, 's')} WHEN 'saturation' THEN {sat(c, 'd')} WHEN 'color' THEN s{c} ELSE d{c} END"


SPREAD_OF = {"s": "greatest(dr, dg, db) - least(dr, dg, db)", "d": "greatest(sr, sg, sb) - least(sr, sg, sb)"}


@query("px_blend_modes", f"""
WITH o AS (SELECT image_id, x, y, CASE image_id % 16 {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODES))} END AS mode, r / 255.0::DOUBLE AS dr, g / 255.0::DOUBLE AS dg, b / 255.0::DOUBLE AS db, b / 255.0::DOUBLE AS sr, r / 255.0::DOUBLE AS sg, g / 255.0::DOUBLE AS sb FROM fx_pixels),
t AS (SELECT *, {', '.join(f"{stretched_sql(c, SPREAD_OF)} AS t{c}" for c in 'rgb')}, CASE mode WHEN 'luminosity' THEN {lum_sql('sr', 'sg', 'sb')} ELSE {lum_sql('dr', 'dg', 'db')} END AS l FROM o),
u AS (SELECT *, {', '.join(f"t{c} + (l - {lum_sql('tr', 'tg', 'tb')}) AS u{c}" for c in 'rgb')} FROM t),
v AS (SELECT *, {lum_sql('ur', 'ug', 'ub')} AS y0, least(ur, ug, ub) AS low, greatest(ur, ug, ub) AS high FROM u),
w AS (SELECT *, {', '.join(f"CASE WHEN low < 0 THEN y0 + (u{c} - y0) * y0 / (y0 - low) ELSE u{c} END AS w{c}" for c in 'rgb')} FROM v),
m AS (SELECT *, {', '.join(f"CASE WHEN high > 1 THEN y0 + (w{c} - y0) * (1 - y0) / (high - y0) ELSE w{c} END AS m{c}" for c in 'rgb')} FROM w)
SELECT image_id, x, y, {', '.join(clamp('(CASE mode ' + ' '.join(f"WHEN '{n}' THEN CAST({q.format(s='s' + c, d='d' + c, c=c)} AS DOUBLE)" for n, q in ONE_SQL.items()) + ' END) * 255') + f' AS {c}' for c in 'rgb')}, 255 AS a FROM m""", "fx_pixels")  # fmt: skip
def px_blend_modes(t):
    return ra.composite(t.sql(BLEND_SQL))


@query("px_round", f"""
WITH d AS (SELECT *, CASE WHEN x < 3 THEN 3 - x - 0.5::DOUBLE WHEN x >= 5 THEN x - 5 + 0.5::DOUBLE ELSE 0 END AS dx, CASE WHEN y < 3 THEN 3 - y - 0.5::DOUBLE WHEN y >= 5 THEN y - 5 + 0.5::DOUBLE ELSE 0 END AS dy FROM fx_pixels)
SELECT image_id, x, y, r, g, b, CASE WHEN dx <> 0 AND dy <> 0 AND sqrt(dx * dx + dy * dy) - 3 > -1 THEN {clamp('a * greatest(0, least(1, 3 - sqrt(dx * dx + dy * dy)))')} ELSE a END AS a FROM d""", "fx_pixels")  # fmt: skip
def px_round(t):
    return ra.round_corners(t.fx_pixels, 3)


@query("px_border", f"""
WITH d AS (SELECT *, CASE WHEN x < 3 THEN 3 - x WHEN x >= 5 THEN x - 5 + 1 ELSE 0 END AS dx, CASE WHEN y < 3 THEN 3 - y WHEN y >= 5 THEN y - 5 + 1 ELSE 0 END AS dy FROM fx_pixels),
e AS (SELECT *, CASE WHEN dx <> 0 AND dy <> 0 THEN 3 - sqrt(dx * dx + dy * dy) ELSE CAST(least(x, y, 7 - x, 7 - y) AS DOUBLE) END AS edge FROM d),
k AS (SELECT *, CASE WHEN edge < 2 THEN least(1, 2 - edge) ELSE 0 END AS k FROM e)
SELECT image_id, x, y, {', '.join(clamp(f'{c} + ({v} - {c}) * k') + f' AS {c}' for c, v in zip('rgb', (200, 30, 90)))}, a FROM k""", "fx_pixels")  # fmt: skip
def px_border(t):
    return ra.border(t.fx_pixels, 2, (200, 30, 90), 3)


@query("px_shadow", f"""
WITH c AS (SELECT image_id, x, y FROM (SELECT DISTINCT image_id FROM fx_pixels), (SELECT unnest(range(12)) AS x), (SELECT unnest(range(12)) AS y)),
s AS (SELECT c.image_id, c.x, c.y, CASE WHEN f.a IS NULL THEN 0 ELSE 40 END AS ink, coalesce({clamp('f.a * 0.5::DOUBLE')}, 0) / 255.0::DOUBLE AS da, t.r, t.g, t.b, coalesce(t.a, 0) / 255.0::DOUBLE AS sa
 FROM c LEFT JOIN fx_pixels f ON f.image_id = c.image_id AND f.x + 4 = c.x AND f.y + 3 = c.y LEFT JOIN fx_pixels t ON t.image_id = c.image_id AND t.x + 2 = c.x AND t.y + 2 = c.y)
SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {', '.join(f"CASE WHEN sa + da * (1 - sa) > 0 THEN {clamp(f'(coalesce({k}, 0) * sa + ink * da * (1 - sa)) / (sa + da * (1 - sa))')} ELSE ink END AS {k}" for k in 'rgb')}, {clamp('(sa + da * (1 - sa)) * 255')} AS a FROM s""", "fx_pixels")  # fmt: skip
def px_shadow(t):
    return ra.drop_shadow(t.fx_pixels, 0, 2, 1, (40, 40, 40))


PLANE_SQL = "SELECT image_id, x, y, r AS m FROM fx_pixels WHERE x < 4 AND y < 2"


@query("px_apply_alpha", f"SELECT p.image_id, p.x, p.y, r, g, b, {rounded('a * m / 255.0::DOUBLE')} AS a FROM fx_pixels p JOIN ({PLANE_SQL}) m ON p.image_id = m.image_id AND p.x // 2 = m.x AND p.y // 4 = m.y", "fx_pixels")
def px_apply_alpha(t):
    return ra.apply_alpha(t.fx_pixels, t.sql(PLANE_SQL))


INKS_SQL = "SELECT image_id, x, y, r / CAST(255.0 AS DOUBLE) AS c, g / CAST(255.0 AS DOUBLE) AS m, b / CAST(255.0 AS DOUBLE) AS y2, x / CAST(14.0 AS DOUBLE) AS k, r % 16 AS idx FROM fx_pixels"


@query("px_color_convert", f"""
SELECT image_id, x, y, 'cmyk' AS space, {', '.join(f"{clamp(f'(1 - {i}) * (1 - k) * 255')} AS {o}" for o, i in zip('rgb', ('c', 'm', 'y2')))} FROM ({INKS_SQL})
UNION ALL SELECT image_id, x, y, 'indexed', CAST(idx * 17 AS INT), CAST(255 - idx * 17 AS INT), CAST(idx % 4 * 85 AS INT) FROM ({INKS_SQL})""", "fx_pixels")  # fmt: skip
def px_color_convert(t):
    inks = t.sql(INKS_SQL)
    palette = t.spark.range(16).select(F.col("id").cast("int").alias("idx"), (F.col("id") * 17).cast("int").alias("r"), (255 - F.col("id") * 17).cast("int").alias("g"), (F.col("id") % 4 * 85).cast("int").alias("b"))
    cmyk = ra.cmyk_to_rgb(inks).select("image_id", "x", "y", F.lit("cmyk").alias("space"), *"rgb")
    return cmyk.unionByName(ra.palette_to_rgb(inks, palette).select("image_id", "x", "y", F.lit("indexed").alias("space"), *"rgb"))


def lab_sql(t: str) -> str:
    return f"CASE WHEN {t} * {t} * {t} > 0.008856::DOUBLE THEN {t} * {t} * {t} ELSE ({t} - 16 / 116::DOUBLE) / 7.787::DOUBLE END"


def srgb_sql(x: float, y: float, z: float) -> str:
    c = f"(lx * {x}::DOUBLE + ly * {y}::DOUBLE + lz * {z}::DOUBLE)"
    return clamp(f"255 * CASE WHEN {c} > 0.0031308::DOUBLE THEN 1.055::DOUBLE * pow(greatest({c}, 0.0::DOUBLE), 1 / 2.4::DOUBLE) - 0.055::DOUBLE ELSE 12.92::DOUBLE * {c} END")


@query("px_color_lab", f"""
WITH f AS (SELECT image_id, x, y, (r / 2.55::DOUBLE + 16) / 116 AS fy, g - 128::DOUBLE AS ca, b - 128::DOUBLE AS cb FROM fx_pixels),
e AS (SELECT *, ca / 500 + fy AS fx, fy - cb / 200 AS fz FROM f),
l AS (SELECT image_id, x, y, 0.95047::DOUBLE * ({lab_sql('fx')}) AS lx, {lab_sql('fy')} AS ly, 1.08883::DOUBLE * ({lab_sql('fz')}) AS lz FROM e)
SELECT image_id, x, y, {srgb_sql(3.2406, -1.5372, -0.4986)} AS r, {srgb_sql(-0.9689, 1.8758, 0.0415)} AS g, {srgb_sql(0.0557, -0.204, 1.057)} AS b FROM l""", "fx_pixels")  # fmt: skip
def px_color_lab(t):
    lab = t.fx_pixels.select("image_id", "x", "y", (F.col("r") / 2.55).alias("cl"), (F.col("g") - 128.0).alias("ca"), (F.col("b") - 128.0).alias("cb"))
    return ra.lab_to_rgb(lab).select("image_id", "x", "y", *"rgb")


@query("px_color_key_mask", "SELECT image_id, x, y, r, g, b, CASE WHEN r BETWEEN 100 AND 150 AND g BETWEEN 90 AND 200 THEN 0 ELSE a END AS a FROM fx_pixels", "fx_pixels")
def px_color_key_mask(t):
    return ra.range_mask(t.fx_pixels, {"r": (100, 150), "g": (90, 200)})


@query("px_delta_decode", f"SELECT image_id, x, y, {rgb(lambda c: f'CAST(sum({c}) OVER w % 256 AS INT)')}, a FROM fx_pixels WINDOW w AS (PARTITION BY image_id, y ORDER BY x)", "fx_pixels")
def px_delta_decode(t):
    return ra.undelta(t.fx_pixels, "left")


CROSSES = "(CASE WHEN (1.0 > y + 0.5) <> (6.0 > y + 0.5) AND floor(1.0 + (y + 0.5 - 1.0) / (6.0 - 1.0)::DOUBLE * (4.0 - 1.0) + 0.5) <= x THEN 1 ELSE 0 END + CASE WHEN (6.0 > y + 0.5) <> (1.0 > y + 0.5) AND floor(4.0 + (y + 0.5 - 6.0) / (1.0 - 6.0)::DOUBLE * (7.0 - 4.0) + 0.5) <= x THEN 1 ELSE 0 END)"


@query("mask_shapes", f"""
SELECT image_id, x, y, CASE WHEN x >= 1 AND x < 6 AND y >= 2 AND y < 5 THEN 255 ELSE 0 END AS rect,
 CASE WHEN pow((y + 0.5 - 4) / 3.0::DOUBLE, 2) <= 1 AND x >= floor(4 - 4 * sqrt(greatest(1 - pow((y + 0.5 - 4) / 3.0::DOUBLE, 2), 0)) + 0.5) AND x < floor(4 + 4 * sqrt(greatest(1 - pow((y + 0.5 - 4) / 3.0::DOUBLE, 2), 0)) + 0.5) THEN 255 ELSE 0 END AS ellipse,
 CASE WHEN {CROSSES} % 2 = 1 THEN 255 ELSE 0 END AS polygon FROM fx_pixels""", "fx_pixels")  # fmt: skip
def mask_shapes(t):
    g = t.fx_pixels.select("image_id", "x", "y")
    rect = mk.mask_rect(g, 6, 5, -5, -3).withColumnRenamed("m", "rect")
    both = mk.mask_ellipse(rect, 0, 1, 8, 6).withColumnRenamed("m", "ellipse")
    return mk.mask_polygon(both, [(1.0, 1.0), (7.0, 1.0), (4.0, 6.0)]).withColumnRenamed("m", "polygon")


A_SQL = "SELECT image_id, x, y, CASE WHEN r > 120 THEN r ELSE 0 END AS m FROM fx_pixels"
B_SQL = "SELECT image_id, x, y, g AS m FROM fx_pixels WHERE (x + y) % 2 = 0"


@query("mask_combine", f"SELECT a.image_id, a.x, a.y, least(a.m, 255 - coalesce(b.m, 0)) AS m, 255 - greatest(a.m, coalesce(b.m, 0)) AS n FROM ({A_SQL}) a LEFT JOIN ({B_SQL}) b ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y", "fx_pixels")
def mask_combine(t):
    a, b = t.sql(A_SQL), t.sql(B_SQL)
    added = mk.invert(mk.combine(a, b, "add")).withColumnRenamed("m", "n")
    return mk.combine(a, b, "subtract").join(added, ra.KEY)


@query("mask_bounds", f"SELECT image_id, min(x) AS bx, min(y) AS by, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh FROM (SELECT image_id, CASE WHEN m > 160 THEN x END AS x, CASE WHEN m > 160 THEN y END AS y FROM ({A_SQL})) GROUP BY image_id", "fx_pixels")
def mask_bounds(t):
    return mk.mask_bounds(t.sql(A_SQL), 160)


@query("mask_feather", f"SELECT image_id, x, y, {rounded('m / 81.0::DOUBLE')} AS m FROM {blur_sql(f'({A_SQL})', 2, 'm')}", "fx_pixels")
def mask_feather(t):
    return mk.feather(t.sql(A_SQL), 1)


@query("mask_grow", f"""
WITH g AS (SELECT image_id, x, y, max(m) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM (SELECT image_id, x, y, max(m) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM ({A_SQL}))),
s AS (SELECT image_id, x, y, CASE WHEN y IN (0, 7) THEN 0 ELSE min(m) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS m FROM (SELECT image_id, x, y, CASE WHEN x IN (0, 7) THEN 0 ELSE min(m) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS m FROM ({A_SQL})))
SELECT g.image_id, g.x, g.y, g.m AS grown, s.m AS shrunk FROM g JOIN s ON g.image_id = s.image_id AND g.x = s.x AND g.y = s.y""", "fx_pixels")  # fmt: skip
def mask_grow(t):
    a = t.sql(A_SQL)
    return mk.grow(a, 1).withColumnRenamed("m", "grown").join(mk.grow(a, -1).withColumnRenamed("m", "shrunk"), ra.KEY)


@query("mask_outline", f"""
WITH i AS (SELECT image_id, x, y FROM ({A_SQL}) WHERE m >= 128),
h AS (SELECT image_id, x, y FROM (SELECT image_id, x, y FROM i UNION ALL SELECT image_id, x, y + 1 FROM i) GROUP BY ALL HAVING count(*) = 1),
v AS (SELECT image_id, x, y FROM (SELECT image_id, x, y FROM i UNION ALL SELECT image_id, x + 1, y FROM i) GROUP BY ALL HAVING count(*) = 1),
hr AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS run FROM h), vr AS (SELECT *, y - row_number() OVER (PARTITION BY image_id, x ORDER BY y) AS run FROM v)
SELECT image_id, min(x) AS x1, y AS y1, max(x) + 1 AS x2, y AS y2 FROM hr GROUP BY image_id, y, run UNION ALL SELECT image_id, x, min(y), x, max(y) + 1 FROM vr GROUP BY image_id, x, run""", "fx_pixels")  # fmt: skip
def mask_outline(t):
    return mk.outline(t.sql(A_SQL))


SEEDS_SQL = "SELECT vec_id AS image_id, CAST(vec_id % 8 AS INT) AS sx, CAST(vec_id % 7 AS INT) AS sy FROM embeddings"
ALIKE_SQL = f"SELECT p.image_id, p.x, p.y, sx, sy, greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b), abs(p.a - q.a)) <= 60 AS ok FROM fx_pixels p JOIN ({SEEDS_SQL}) s ON p.image_id = s.image_id JOIN fx_pixels q ON q.image_id = s.image_id AND q.x = sx AND q.y = sy"


@query("mask_similar", f"SELECT image_id, x, y, CASE WHEN ok THEN 255 ELSE 0 END AS m FROM ({ALIKE_SQL})", "fx_pixels")
def mask_similar(t):
    return mk.similar(t.fx_pixels, t.sql(SEEDS_SQL), 60)


@query("mask_flood", f"""
WITH RECURSIVE k AS (SELECT * FROM ({ALIKE_SQL})), w AS (SELECT image_id, x, y FROM k WHERE x = sx AND y = sy UNION SELECT k.image_id, k.x, k.y FROM w JOIN k ON k.ok AND k.image_id = w.image_id AND abs(k.x - w.x) + abs(k.y - w.y) = 1)
SELECT k.image_id, k.x, k.y, CASE WHEN w.x IS NULL THEN 0 ELSE 255 END AS m FROM k LEFT JOIN w ON k.image_id = w.image_id AND k.x = w.x AND k.y = w.y""", "fx_pixels")  # fmt: skip
def mask_flood(t):
    return mk.flood(t.fx_pixels, t.sql(SEEDS_SQL), 60)


@query("mask_apply", f"SELECT p.image_id, p.x, p.y, {', '.join(f'{rounded(f'p.{c} + ({v} - p.{c}) * (m / 255.0::DOUBLE)')} AS {c}' for c, v in zip('rgba', (10, 20, 30, 255)))} FROM fx_pixels p JOIN ({A_SQL}) m ON p.image_id = m.image_id AND p.x = m.x AND p.y = m.y", "fx_pixels")
def mask_apply(t):
    return mk.fill_masked(t.fx_pixels, t.sql(A_SQL), (10, 20, 30, 255))


@query("mask_from_alpha", f"SELECT image_id, x, y, a AS m FROM ({HOLES_SQL})", "fx_pixels")
def mask_from_alpha(t):
    return mk.alpha_mask(t.sql(HOLES_SQL))


@query("mask_extract", f"""
SELECT p.image_id, p.x, p.y, r, g, b, {rounded('a * (1 - m / 255.0::DOUBLE)')} AS a, 0 AS z FROM fx_pixels p JOIN ({A_SQL}) m ON p.image_id = m.image_id AND p.x = m.x AND p.y = m.y
UNION ALL SELECT p.image_id, p.x, p.y, r, g, b, {rounded('a * m / 255.0::DOUBLE')}, 1 FROM fx_pixels p JOIN ({A_SQL}) m ON p.image_id = m.image_id AND p.x = m.x AND p.y = m.y WHERE m > 0""", "fx_pixels")  # fmt: skip
def mask_extract(t):
    return mk.extract_layer(t.fx_pixels, t.sql(A_SQL), True)
